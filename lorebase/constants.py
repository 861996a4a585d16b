"""Thresholds and weights. Results depend on them."""

DECAY_EPISODIC, DECAY_SEMANTIC, DECAY_FLOOR = 0.015, 0.00385, 0.1
DECAY_BOOST = 1.5
HYBRID_MIN_ROWS, RRF_K = 10, 60
BM25_K1, BM25_B = 1.2, 0.75
BM25_WEIGHTS = {"content": 5, "project": 2, "tags": 3}
IMPORTANCE_FLOORS = ((20, 8), (10, 7), (5, 6))
IMPORTANCE_BOOST, ACCESS_BOOST, ACCESS_CAP = 0.3, 0.05, 20
CONFIRM_RECENT, CONFIRM_OLDER = (30, 0.3), (90, 0.15)
DEDUP_DISTANCE, DEDUP_WIDEN = 0.40, 1.5
CONTRADICT_DISTANCE, CONTRADICT_SKIP, CONTRADICT_SURE = 0.35, 0.35, 0.60
DEDUP_RERANK, NLI_CONTRA, NLI_DEDUP, NLI_CANDIDATES = 0.85, 0.98, 0.85, 3
FINDER_THRESHOLD, FINDER_PAIRS = 0.8, 200
BAND_MIN, BAND_MAX, BAND_PERCENTILE, BAND_LEAST = 0.60, 0.85, 0.99, 20
MERGE_TAU, MERGE_MIN_LINE = 0.90, 25
GATE_TAU, GATE_LINES = 0.70, 8
CANDIDACY_K, CANDIDACY_FLOOR = 3, 0.5
NOVELTY_TAU = 0.85
WEAVE_MIN, WEAVE_TOP = 0.55, 3
PACKET_SIZE, BUDGET_NORMAL, BUDGET_SURGE, SURGE = 25, 30, 80, 50
SKIP_IMPORTANCE, CLUSTER_SIZE = 9, 8
CHUNK_CHARS, MAX_FILE_BYTES = 2000, 50 << 20
SPLIT_THRESHOLD, SPLIT_TARGET = 4000, 2400
TAG_BUDGET = 1024

TYPES = ("fact", "decision", "learning", "preference", "todo")
LAYERS = ("semantic", "episodic")
MUTABLE = ("project", "content", "tags", "importance", "status", "type", "layer", "verified", "consolidation_lock", "subcategory", "valid_from", "valid_until", "last_confirmed", "last_accessed", "access_count")

STOP_WORDS = "a an and are as at be by for from has have in is it of on or that the to was were will with".split()
#: Words that mark English prose.
ENGLISH = (
    "the and is are was were of to in for with on at by from that this it as be has have had not but or an when which will "
    "would should there their then than these those its into about after before only"
).split()
#: Operator glyphs and the words they stand for.
GLYPHS = {
    "∵": " because ", "∴": " therefore ", "△": " changed from ", "⚠": " warning ", "✓": " confirmed ", "✗": " rejected ", "→": " -> ",
    "↔": " <-> ", "←": " <- ", "∅": " none ", "⟪": " ", "⟫": " ", "═": " ",
}
#: UTF-8 read as Latin-1 or cp1252 leaves these.
MOJIBAKE = ("â€", "â†", "âˆ", "â–", "âœ", "Ã¥", "Ã¤", "Ã¶", "Ã©", "Â»", "Â«", "�")
BOOKKEEPING_TAGS = ("consolidated", "nyx-split", "nyx-cycle", "synthesized", "bridge")
BOOKKEEPING_PREFIXES = ("merged-into", "split-from", "split-part")
TEXT_EXTENSIONS = (
    "txt md markdown rst log py js jsx ts tsx rb go rs java c h cpp hpp cs php sh bash zsh json yaml yml toml ini conf cfg "
    "html htm xml css scss sass sql csv tsv env dockerfile gitignore"
).split()
