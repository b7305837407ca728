"""Named queries by theme; importing this package registers all of them."""

from . import corpus, evaluation, evidence, files, inference, loops, retrieval, runlogs, stream, systems  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
