"""Verification: entailment of claims by a package, confidence, contradiction handling, the final answer."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..schema import CLAIM_TYPES, DERIVED, PREDICATES
from ..storage import keep
from .adjacency import Adjacency
from .paths import reached_paths
from .reconcile import independence_group

FACTORS = list(S.VERIFICATION_WEIGHTS)
CLAIM = "subject string, predicate string, object string, claim_type string"


def parse_claims(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Claims (answer_id, claim_id, subject, predicate, object, claim_type) of answers (answer_id, json), and answers that are malformed.

    An answer with one claim of an unknown predicate or type is malformed as a whole.
    """
    parsed = answers.withColumn("a", F.from_json("json", f"explanation string, claims array<struct<{CLAIM.replace(' string', ':string')}>>"))
    good = F.exists("a.claims", lambda c: ~F.coalesce(c["predicate"].isin(*PREDICATES, *DERIVED) & F.coalesce(c["claim_type"], F.lit("UNKNOWN")).isin(*CLAIM_TYPES) & c["subject"].isNotNull() & c["object"].isNotNull(), F.lit(False)))
    parsed = parsed.withColumn("ok", F.coalesce(~good, F.lit(False)))
    claims = parsed.where("ok").select("answer_id", F.posexplode("a.claims").alias("claim_id", "c")).select("answer_id", "claim_id", "c.*")
    return claims, parsed.where("NOT ok").select("answer_id")


def entail(claims: DataFrame, edges: DataFrame | Adjacency) -> DataFrame:
    """claim_id, method (DIRECT_EDGE, PATH_EXISTENCE, NONE) and the matched edges, as an array of structs.

    A stored predicate matches its edge exactly; a derived one needs a path over its base predicate.
    """
    claims, none = claims.select("claim_id", "subject", "predicate", "object"), "array<struct<subject:{0},predicate:string,object:{0}>>".format(claims.schema["subject"].dataType.simpleString())
    is_derived = F.coalesce(F.col("predicate").isin(*DERIVED), F.lit(False))
    base = S.mapped(F.col("predicate"), DERIVED)
    plain, derived = claims.where(~is_derived), claims.where(is_derived).withColumn("predicate", base)
    stored = edges
    if not isinstance(edges, DataFrame):  # of stored edges, those of the claims' subjects and predicates
        wanted = [r["predicate"] for r in plain.select("predicate").distinct().collect()]  # a closed vocabulary
        stored = edges.at(plain.select(F.col("subject").alias("node")), wanted).out if wanted else None
    parts = []
    if stored is not None:
        hit = stored.select("subject", "predicate", "object").distinct().withColumn("hit", F.lit(True))  # entities may share an id
        rows = plain.join(hit, ["subject", "predicate", "object"], "left")
        edge = F.array(F.struct("subject", "predicate", "object")).cast(none)
        parts.append(rows.select("claim_id", F.when(F.col("hit"), "DIRECT_EDGE").otherwise("NONE").alias("method"), F.when(F.col("hit"), edge).alias("matched")))
    paths = reached_paths(edges, derived, unanswered=True)
    nodes = F.concat(F.array("subject"), F.col("path"))
    steps = F.transform(F.sequence(F.lit(0), F.size("path") - 1), lambda i: F.struct(F.get(nodes, i).alias("subject"), F.col("predicate").alias("predicate"), F.get(nodes, i + 1).alias("object"))).cast(none)
    parts.append(paths.select("claim_id", F.when(F.col("path").isNotNull(), "PATH_EXISTENCE").otherwise("NONE").alias("method"), F.when(F.col("path").isNotNull(), steps).alias("matched")))
    return reduce(DataFrame.unionByName, parts)


def verify_claims(claims: DataFrame, edges: DataFrame, evidence: DataFrame, coverage: DataFrame, now: Column, authority: DataFrame | None = None) -> DataFrame:
    """claim_id, method, the six factors, contradiction level, confidence and status of each claim.

    edges: subject, predicate, object, contradiction_score, supporting_evidence_ids. coverage: one row a capability.
    A path's contradiction is its largest, its support goes by the mean. Matched edges without evidence leave support alone.
    """
    method = keep(entail(claims, edges))
    matched = keep(method.where("method <> 'NONE'").select("claim_id", F.explode("matched").alias("e")).select("claim_id", "e.*").join(edges, ["subject", "predicate", "object"]).select("claim_id", "contradiction_score", "supporting_evidence_ids"))
    per_claim = matched.groupBy("claim_id").agg(F.avg("contradiction_score").alias("mean"), F.max("contradiction_score").alias("worst"))
    records = matched.select("claim_id", F.explode("supporting_evidence_ids").alias("evidence_id")).repartition("evidence_id").distinct().join(evidence.withColumn("group", independence_group()), "evidence_id")
    if authority is None:
        records = records.withColumn("authority", F.lit(1.0))
    else:
        records = records.join(authority.select("provider", "authority"), "provider", "left").withColumn("authority", F.coalesce("authority", F.lit(1.0)))
    records = records.select("claim_id", "confidence", "group", "freshness", "authority").repartition("claim_id")  # dealt once for the distinct count and the rest
    known = records.groupBy("claim_id").agg(F.avg("confidence").alias("evidence_quality"), (F.countDistinct("group") / F.count("*")).alias("evidence_independence"), F.avg(S.freshness(F.col("freshness"), now)).alias("freshness"), F.avg("authority").alias("provider_authority"))
    covered = coverage.agg(F.coalesce(F.avg(S.coverage_factor(F.col("coverage"))), F.lit(0.0)).alias("covered"))  # one row
    rows = method.select("claim_id", "method").join(per_claim, "claim_id", "left").join(known, "claim_id", "left").join(F.broadcast(covered))
    has = F.col("evidence_quality").isNotNull()
    factors = {
        "evidence_support": F.when(F.col("mean").isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), 1 - F.col("mean"))),
        **{c: F.coalesce(c, F.lit(0.0)) for c in ("evidence_quality", "evidence_independence", "freshness", "provider_authority")},
        "coverage": F.when(has, F.col("covered")).otherwise(0.0),
    }
    level = S.contradiction_level(F.coalesce("worst", F.lit(0.0)))
    rows = rows.select("claim_id", "method", *(F.round(factors[k], 9).alias(k) for k in FACTORS), level.alias("contradiction_level"))
    rows = rows.withColumn("confidence", F.round(S.verification_confidence(F.col("contradiction_level")), 9))
    return rows.withColumn("status", S.claim_status(F.col("method") != "NONE", F.col("contradiction_level"), F.col("confidence")))


def handle_contradictions(claims: DataFrame, verified: DataFrame) -> tuple[DataFrame, DataFrame, str | None]:
    """Claims that stay, claims that go, and what to tell the writer; claims have an answer's few rows."""
    rows = claims.join(verified, "claim_id")
    removed = rows.where("contradiction_level = 'SIGNIFICANT'")
    lines = [f"- REMOVE: {r.subject} {r.predicate} {r.object} (contradicted by evidence)" for r in removed.orderBy("claim_id").collect()]  # the claims of one answer
    return rows.where("contradiction_level <> 'SIGNIFICANT'"), removed, "\n".join(["The following claims must be removed:", *lines]) if lines else None


@dataclass
class Generation:
    """What a model gave: OK with an explanation and claims (dicts of CLAIM), or a status of failure."""

    status: str
    explanation: str = ""
    claims: list[dict] = field(default_factory=list)


@dataclass
class Resynthesis:
    outcome: str
    explanation: str
    retained: list[dict]
    removed: list[dict]
    attempts: int
    failure_reason: str | None = None


def verification_loop(spark, generate: Callable[[str | None], Generation], verify: Callable[[DataFrame], DataFrame]) -> Resynthesis:
    """At most two generations that share one retry: malformed output and contradictions retry, other failures do not.

    generate takes the feedback (or None); verify takes claims (claim_id, CLAIM) and returns verify_claims' rows.
    """
    feedback, retry, removed, attempts = None, True, [], 0
    while True:
        attempts += 1
        got = generate(feedback)
        if got.status != "OK":
            if got.status == "MALFORMED_OUTPUT" and retry:
                retry, feedback = False, "The last answer was not valid. Answer with JSON of the agreed form."
                continue
            return Resynthesis("GENERATION_FAILED", "", [], removed, attempts, f"generation_status={got.status}")
        rows = [(str(k), c["subject"], c["predicate"], c["object"], c.get("claim_type", "FACT")) for k, c in enumerate(got.claims)]
        claims = spark.createDataFrame(rows, f"claim_id string, {CLAIM}")
        stay, go, told = handle_contradictions(claims, verify(claims))
        removed += [r.asDict() for r in go.orderBy("claim_id").collect()]
        if told and retry:
            retry, feedback = False, told
            continue
        return Resynthesis("RESOLVED", got.explanation, [r.asDict() for r in stay.orderBy("claim_id").collect()], removed, attempts)


def answers(claims: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, decision, verification_status, label, bucket, limitations of each query's answer.

    claims: query_id, subject, predicate, object, status, removed. queries: query_id, failed, negative (null,
    NO_EVIDENCE_FOUND or INCONCLUSIVE).
    """
    stays = ~F.col("removed")
    text = F.concat(F.lit("Claim '"), F.concat_ws(" ", "subject", "predicate", "object"), F.lit("' could not be verified ("), F.col("status"), F.lit(")"))
    counts = claims.groupBy("query_id").agg(
        F.count_if(stays).alias("retained"), F.count_if(stays & (F.col("status") == "VERIFIED")).alias("verified"), F.count_if("removed").alias("gone"),
        F.array_sort(F.collect_list(F.when(stays & (F.col("status") != "VERIFIED"), text))).alias("open"),
    )
    rows = queries.join(counts, "query_id", "left").fillna(0, ["retained", "verified", "gone"])
    none = F.col("verified") == 0
    status = S.answer_status(F.col("retained"), F.col("verified"), F.col("gone"))
    failed, absent, unsure = F.col("failed"), none & F.coalesce(F.col("negative") == "NO_EVIDENCE_FOUND", F.lit(False)), none & F.coalesce(F.col("negative") == "INCONCLUSIVE", F.lit(False))
    nothing = none & (F.col("gone") == 0)
    final = F.when(failed, "REJECTED").when(absent, "VERIFIED").when(unsure | nothing, "INCONCLUSIVE").otherwise(status)
    strong = S.mapped(status, S.BUCKETS) == "VERIFIED"
    decision = F.when(failed, "ABSTAIN").when(absent, "STRONG_ANSWER").when(unsure | nothing, "ABSTAIN").when(strong, "STRONG_ANSWER").otherwise("QUALIFIED_ANSWER")
    gone = F.when(F.col("gone") > 0, F.concat(F.col("gone").cast("string"), F.lit(" claim(s) were removed: contradicted by deterministic evidence")))
    limits = F.concat(F.array_compact(F.array(gone)), F.coalesce("open", F.array().cast("array<string>")), F.array_compact(F.array(F.when(F.col("negative").isNotNull(), F.concat(F.lit("negative_query_result="), F.col("negative"))))))
    out = rows.select("query_id", decision.alias("decision"), final.alias("verification_status"), limits.alias("limitations"))
    return out.withColumns({"label": S.mapped(F.col("verification_status"), S.LABELS), "bucket": S.mapped(F.col("verification_status"), S.BUCKETS)})
