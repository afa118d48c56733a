"""All registered queries of this subpackage; importing it fills the registry."""

from tablecraft.llm import boilerplate, chunks, cross_entropy, fingerprints, hamming, language, lattice, mixing, phrases, rank_bpe, suffixes, token_cache, treap  # noqa: F401
from tablecraft.llm.registry import ORACLE, QUERIES  # noqa: F401
