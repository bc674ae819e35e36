"""From a question's text to a contract: rules, ambiguity, complexity, evidence and predicates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring as S

DETERMINISTIC_ABOVE, ESCALATE_BELOW = 0.95, 0.50
TOKEN_BUDGET, LATENCY_MS = 4000, 5000
SHORTEST_TARGET = 2
T = r"([\w.]+)"

# Intent, pattern, score, groups that name targets. The last rule counts only where nothing else found its intent.
RULES = (
    ("FIND_CALLERS", rf"\bwho\s+calls\s+{T}", 0.97, 1),
    ("FIND_CALLERS", rf"\bfind\s+(?:the\s+)?callers\s+of\s+{T}", 0.97, 1),
    ("FIND_CALLERS", rf"\bwhat\s+calls\s+{T}", 0.97, 1),
    ("FIND_CALLERS", rf"\blist\s+(?:the\s+)?callers\s+of\s+{T}", 0.97, 1),
    ("FIND_TESTS", rf"\bwhich\s+tests?\s+(?:call|cover|test|exercise)\s+{T}", 0.97, 1),
    ("FIND_TESTS", rf"\bfind\s+tests?\s+(?:for|covering|that\s+call)\s+{T}", 0.97, 1),
    ("FIND_IMPLEMENTATIONS", rf"\b(?:find\s+)?implementations?\s+of\s+{T}", 0.97, 1),
    ("FIND_IMPLEMENTATIONS", rf"\b(?:what|who)\s+implements?\s+{T}", 0.97, 1),
    ("FIND_REFERENCES", rf"\b(?:what|who)\s+references?\s+{T}", 0.97, 1),
    ("FIND_REFERENCES", rf"\breferences?\s+to\s+{T}", 0.97, 1),
    ("FIND_IMPACT", rf"\bimpact\s+of\s+(?:changing\s+)?{T}", 0.97, 1),
    ("FIND_DEPENDENCIES", rf"\bwhat\s+does\s+{T}\s+depend\s+on\b", 0.97, 1),
    ("HISTORY_ANALYSIS", rf"\bhistory\s+of\s+{T}", 0.97, 1),
    ("ARCHITECTURE_ANALYSIS", rf"\barchitecture\s+of\s+{T}", 0.97, 1),
    ("TRACE_EXECUTION", rf"\bwhat\s+happens\s+when\s+{T}(?:\(\))?\s+(?:is\s+)?(?:invoked|called|runs?)\b", 0.97, 1),
    ("TRACE_EXECUTION", rf"\btrace\s+what\s+happens\s+from\s+{T}", 0.97, 1),
    ("TRACE_EXECUTION", rf"\bcall\s+path\s+from\s+{T}", 0.97, 1),
    ("FIND_IMPACT", rf"\bif\s+{T}\s+changes?\b.*\baffected\b", 0.97, 1),
    ("TRACE_EXECUTION", rf"\bwhy\s+does\s+{T}\s+call\s+{T}", 0.80, 2),
    ("TRACE_EXECUTION", rf"\btrace\s+(?:the\s+)?execution\s+of\s+{T}", 0.97, 1),
    ("CODE_LOOKUP", rf"\beverything\s+related\s+to\s+{T}", 0.45, 1),
    ("FIND_CALLERS", r"\bcalls?\b", 0.35, 0),
)

# Intent -> evidence it needs, depth, and whether an empty answer may say that there is nothing.
INTENTS = {
    "FIND_CALLERS": (("CALL_RELATIONSHIP", "SYMBOL_REFERENCE"), 1, True),
    "FIND_TESTS": (("CALL_RELATIONSHIP", "SYMBOL_REFERENCE"), 1, True),
    "FIND_IMPLEMENTATIONS": (("IMPLEMENTATION",), 1, True),
    "FIND_REFERENCES": (("SYMBOL_REFERENCE", "TYPE_RELATIONSHIP"), 1, True),
    "FIND_DEPENDENCIES": (("DEPENDENCY",), 1, True),
    "TRACE_EXECUTION": (("CALL_RELATIONSHIP", "DATA_FLOW"), 2, True),
    "FIND_IMPACT": (("CALL_RELATIONSHIP", "DATA_FLOW", "DEPENDENCY"), 2, True),
    "ARCHITECTURE_ANALYSIS": (("IMPLEMENTATION", "SYMBOL_DEFINITION", "TYPE_RELATIONSHIP"), 2, False),
    "CODE_LOOKUP": (("SYMBOL_DEFINITION",), 0, False),
    "HISTORY_ANALYSIS": (("HISTORY",), 0, False),
    "UNKNOWN": ((), 0, False),
}
# Which predicates a capability backs.
BACKS = {"CALL_RELATIONSHIP": ("CALLS",), "SYMBOL_REFERENCE": ("REFERENCES", "IMPORTS"), "IMPLEMENTATION": ("IMPLEMENTS",), "TYPE_RELATIONSHIP": ("REFERENCES",), "DATA_FLOW": ("REFERENCES",), "DEPENDENCY": ("DEPENDS_ON",), "CO_CHANGE": ("CO_CHANGED_WITH",)}


def predicates_of(intent: str) -> list[str]:
    return sorted({p for c in INTENTS[intent][0] for p in BACKS.get(c, ())})


def contract_table(spark) -> DataFrame:
    """intent, required_evidence, relationship_types, depth, negative: one row an intent."""
    rows = [(k, sorted(e), predicates_of(k), d, n) for k, (e, d, n) in INTENTS.items()]
    return spark.createDataFrame(rows, "intent string, required_evidence array<string>, relationship_types array<string>, depth int, negative boolean")


def normalized(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), r"(?U)\s+", " ")


def candidates(text: Column) -> Column:
    """Array of (intent, score, targets) that the rules find in a normalised text, best first, ties in rule order."""
    found = []
    for k, (intent, pattern, score, groups) in enumerate(RULES):
        regex = "(?iU)" + pattern
        targets = F.filter(F.array(*(F.regexp_extract(text, regex, g) for g in range(1, groups + 1))), lambda t: F.length(t) >= SHORTEST_TARGET) if groups else F.array().cast("array<string>")
        hit = F.rlike(text, F.lit(regex))
        if k == len(RULES) - 1:
            earlier = [F.rlike(text, F.lit("(?iU)" + p)) for i, p, *_ in RULES[:-1] if i == intent]
            for e in earlier:
                hit = hit & ~e
        found.append(F.when(hit, F.struct(F.lit(-score).alias("order"), F.lit(k).alias("rule"), F.lit(intent).alias("intent"), F.lit(score).alias("score"), targets.alias("targets"))))
    return F.transform(F.array_sort(F.array_compact(F.array(*found))), lambda c: F.struct(c["intent"].alias("intent"), c["score"].alias("score"), c["targets"].alias("targets")))


def understand(questions: DataFrame, contracts: DataFrame, slm: Callable[[DataFrame], DataFrame] | None = None, token_budget: int = TOKEN_BUDGET, latency_budget_ms: int = LATENCY_MS) -> DataFrame:
    """query_id, status, intent, targets, relationship_types, required_evidence, complexity, ambiguity, confidence, budgets, depth, negative.

    questions: query_id, text. A rule over DETERMINISTIC_ABOVE resolves a question. For the others slm, where given,
    takes (query_id, text, candidates) and returns query_id, intent, targets, relationship_types, ambiguity,
    temporal, reasoning and confidence; without one they stay SLM_UNAVAILABLE.
    """
    # Out of a generator, so that no filter on what the rules find is moved before them, which would run them again.
    rows = questions.withColumn("text", normalized(F.col("text"))).withColumn("r", F.explode(F.array(F.struct("text", candidates(F.col("text")).alias("candidates"))))).select("query_id", "r.*")
    top = F.try_element_at("candidates", F.lit(1))
    rows = rows.withColumns({"top": top, "sure": F.coalesce(top["score"] > DETERMINISTIC_ABOVE, F.lit(False)), "ambiguity": S.ambiguity(F.transform("candidates", lambda c: c["score"]))})
    zero = F.lit(0.0)
    intents = F.size(F.array_distinct(F.transform("candidates", lambda c: c["intent"])))
    contracts = F.broadcast(contracts)  # one row an intent
    ruled = rows.select("query_id", "sure", F.col("top.intent").alias("intent"), F.col("top.targets").alias("targets"), "ambiguity", F.col("top.score").alias("confidence"), S.complexity(intent_count=S.capped_share(intents), target_count=S.capped_share(F.size("top.targets")), relationship_depth=zero, ambiguity=F.col("ambiguity"), temporal_dimension=zero, reasoning_requirement=zero).alias("complexity"))
    ruled = ruled.join(contracts, "intent", "left").withColumn("status", F.lit("RESOLVED"))
    columns = ["query_id", "status", "intent", "targets", "relationship_types", "required_evidence", "complexity", "ambiguity", "confidence", "depth", "negative"]
    if slm is None:  # one pass
        out = ruled.select("query_id", F.when(F.col("sure"), F.col("status")).otherwise("SLM_UNAVAILABLE").alias("status"), *(F.when(F.col("sure"), F.col(c)).alias(c) for c in columns[2:]))
    else:
        said = slm(rows.where("NOT sure").select("query_id", "text", "candidates"))
        parts = S.complexity(
            intent_count=F.when(F.col("intent") == "UNKNOWN", 0.0).otherwise(S.capped_share(F.lit(1))), target_count=S.capped_share(F.size("targets")), relationship_depth=S.capped_share(F.size("relationship_types")),
            ambiguity=F.col("ambiguity"), temporal_dimension=F.when(F.col("temporal") == "NONE", 0.0).otherwise(1.0), reasoning_requirement=F.col("reasoning"),
        )
        said = said.join(contracts.drop("relationship_types"), "intent", "left").withColumn("complexity", parts)
        sure = F.col("confidence") >= ESCALATE_BELOW
        rest = said.select("query_id", F.when(sure, "RESOLVED").otherwise("LLM_ESCALATION_REQUIRED").alias("status"), *(F.when(sure, F.col(c)).alias(c) for c in columns[2:]))
        out = ruled.where("sure").select(*columns).unionByName(rest)
    return out.withColumns({"token_budget": F.lit(token_budget), "latency_budget_ms": F.lit(latency_budget_ms)})


def session_weights(history: DataFrame, now: Column, minutes: int = 30, most: int = 10, half_life: float = 5.0) -> DataFrame:
    """The last queries of each repository within the window, the latest first, with a weight that halves every half_life ranks.

    history: repository_id, seq (the order of recording), observed_at.
    """
    recent = history.where(F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("observed_at").cast("timestamp")) <= minutes * 60_000_000)
    ranked = recent.withColumn("rank", F.row_number().over(Window.partitionBy("repository_id").orderBy(F.desc("seq")))).where(F.col("rank") <= most)
    return ranked.withColumn("weight", F.pow(F.lit(0.5), (F.col("rank") - 1) / F.lit(half_life)))
