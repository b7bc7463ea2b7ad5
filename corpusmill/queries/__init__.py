from . import answers, asks, corpus, documents, retrieval  # noqa: F401
from .base import ORACLES, QUERIES  # noqa: F401
