"""Fixed values that define results: weights, rates, thresholds and word lists."""

from __future__ import annotations

SECTORS = ("episodic", "semantic", "procedural", "emotional", "reflective")
#: Similarity penalty of a memory's sector (inner) for a query's sector (outer); unknown pairs take DEFAULT_PENALTY.
PENALTY = {
    "episodic": {"semantic": 0.6, "procedural": 0.6, "emotional": 0.7, "reflective": 0.8},
    "semantic": {"episodic": 0.6, "procedural": 0.8, "emotional": 0.4, "reflective": 0.7},
    "procedural": {"episodic": 0.6, "semantic": 0.8, "emotional": 0.3, "reflective": 0.6},
    "emotional": {"episodic": 0.7, "semantic": 0.4, "procedural": 0.3, "reflective": 0.6},
    "reflective": {"episodic": 0.8, "semantic": 0.7, "procedural": 0.6, "emotional": 0.6},
}
DEFAULT_PENALTY = 0.3
#: How much a memory's sector (row) resonates with a query's (column), in the order of SECTORS.
RESONANCE = (
    (1.0, 0.7, 0.3, 0.6, 0.6),
    (0.7, 1.0, 0.4, 0.7, 0.8),
    (0.3, 0.4, 1.0, 0.5, 0.2),
    (0.6, 0.7, 0.5, 1.0, 0.8),
    (0.6, 0.8, 0.2, 0.8, 1.0),
)
#: Weight of a sector's similarity if it is the query's primary sector, and if not.
SECTOR_WEIGHTS = {"episodic": (1.4, 0.7), "semantic": (1.2, 0.8), "procedural": (1.3, 0.7), "emotional": (1.5, 0.6), "reflective": (1.1, 0.5)}
DECAY_RATES = {"episodic": 0.015, "semantic": 0.005, "procedural": 0.008, "emotional": 0.02, "reflective": 0.001}

SCORE_WEIGHTS = {"similarity": 0.35, "overlap": 0.20, "waypoint": 0.15, "recency": 0.10, "tags": 0.20}
BOOST = 3.0
FLOOR_SALIENCE = 0.08
RECENCY_RATE = 0.05
KEYWORD_SHARE = 0.15
GRAPH_BONUS = 0.12
QA_BONUS = 0.2
WAYPOINT_GATE = 0.55
WAYPOINT_DAMPING, WAYPOINT_LEAST = 0.8, 0.1

TIER_RATES = {"hot": 0.005, "warm": 0.02, "cold": 0.05}
RECENT_DAYS = 6
COMPRESS_BELOW, FINGERPRINT_BELOW = 0.7, 0.3
LEAST_DIM, MOST_DIM = 64, 1536
TRACE_RATE = 0.18
HIT_BONUS = 0.15
NEIGHBOUR_RATE, NEIGHBOUR_DECAY = 0.2, 0.02
DUPLICATE_SIMILARITY = 0.95
CANONICAL_SIMILARITY = 0.85

EDGE_WEIGHTS = {"SAME_AS": 1.00, "PART_OF": 0.92, "LOCATED_IN": 0.84, "WORKED_WITH": 0.80, "KNOWS": 0.78, "CAUSES": 0.74, "PRECEDES": 0.66, "CO_OCCURS_WITH": 0.50, "RELATED_TO": 0.30}
#: Words that tell a relation, in order of the rules; the first and the last hold only between two entities of the type named.
RELATION_RULES = (
    ("LOCATED_IN", "LOCATION", ("位于", "属于", "inside", "within", " in ", " at ")),
    ("CAUSES", None, ("因为", "导致", "因此", "so that", "because", "caused by", "lead to")),
    ("PRECEDES", None, ("之后", "随后", "然后", "before", "after", "later", "earlier")),
    ("WORKED_WITH", "PERSON", ("同事", "合作", "团队", "项目", "coworker", "colleague", "teammate", "worked with")),
)

#: Words that count as the first of their line.
SYNONYMS = (
    ("prefer", "like", "love", "enjoy", "favor"),
    ("theme", "mode", "style", "layout"),
    ("meeting", "meet", "session", "call", "sync"),
    ("dark", "night", "black"),
    ("light", "bright", "day"),
    ("user", "person", "people", "customer"),
    ("task", "todo", "job"),
    ("note", "memo", "reminder"),
    ("time", "schedule", "when", "date"),
    ("project", "initiative", "plan"),
    ("issue", "problem", "bug"),
    ("document", "doc", "file"),
    ("question", "query", "ask"),
)
#: Endings and what they become; the first that leaves three letters or more holds.
STEMS = (("ies", "y"), ("ing", ""), ("ers?", "er"), ("ed", ""), ("s", ""))
#: Parts of speech of CJK words without content: a word of one character that has one of these is left out.
CJK_STOP_FLAGS = frozenset("p c u uj um uv uz d dg df y z x xx v vd vshi vyou vf vx vg vi vl ag al rr rz rt".split())
