"""Operator 6: quality rules with risk-controlled thresholds.

A rule is a score from 0 to 1 that is high for bad texts; a document is rejected where a score
exceeds the cutoff of its stratum (language) and rule. Cutoffs come from labelled good documents
held out for that. In each stratum and for each rule the cutoffs 1, 1 - 1/STEPS, ... are tested in that
fixed order: as long as k rejections of n good documents or fewer have a
binomial chance of at most DELTA / tests under a false rejection rate of RISK / rules, the rate is
certified to be lower, and the next stricter cutoff is tried. The order needs no correction
within a rule; the division by the tests (strata times rules) is Bonferroni's over the others. So with
confidence 1 - DELTA every stratum loses less than RISK of its good documents.

Scores are built-in expressions; the text is read once. The bound needs documents drawn apart from each other, so
equal texts of a stratum count once among the labelled ones; near copies count each.

Defined results: a null or empty text has scores of 0 and is kept; a null language is the
stratum ''; a stratum with too few labels has no cutoffs and keeps all; a document labelled both good and bad counts as bad;
repeated rows are judged each; a score at its cutoff is kept; a very long text is scored whole; an empty table gives no rows;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragloom.llm.common import checkpointed

RISK, DELTA, STEPS = 0.02, 0.05, 50
SIGNS, CAPITALS, DIGITS = "#$%&*|!~^<>{}", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
RULES = ["sign_share", "capital_share", "digit_share", "repeated_lines", "repeated_words"]


def _share(text: Column, of: str) -> Column:
    left = F.length(F.translate(text, of, ""))
    return F.when(F.length(text) > 0, (F.length(text) - left) / F.length(text)).otherwise(F.lit(0.0))


def _repeated(text: Column, by: str) -> Column:
    parts = F.split(text, by)
    return 1.0 - F.size(F.array_distinct(parts)) / F.size(parts)


def scores(docs: DataFrame) -> DataFrame:
    """(doc_id, stratum, th, one column a rule) of every row; th is a hash of the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("stratum"),
        F.xxhash64(text).alias("th"),
        _share(text, SIGNS).alias("sign_share"),
        _share(text, CAPITALS).alias("capital_share"),
        _share(text, DIGITS).alias("digit_share"),
        _repeated(text, "\n").alias("repeated_lines"),
        _repeated(text, " ").alias("repeated_words"),
    )


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(Bin(n, p) <= k), summed exactly from k down till terms no longer count."""
    if k >= n:
        return 1.0
    total, j = 0.0, k
    while j >= 0:
        term = math.exp(math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(p) + (n - j) * math.log1p(-p))
        total += term
        if term < total * 1e-17 and j < n * p:
            break
        j -= 1
    return min(1.0, total)


def select_cutoffs(over: dict[tuple[str, str], list[int]], risk: float = RISK, delta: float = DELTA) -> dict[tuple[str, str], int]:
    """Least certified cutoff, in steps, by (stratum, rule). over: good documents in each class of ceil(score * STEPS)."""
    rules = {rule for _, rule in over}
    out = {}
    for at, classes in over.items():
        n, rejected = sum(classes), 0
        best = None
        for step in range(STEPS, -1, -1):
            rejected = sum(classes[step + 1 :])
            if n == 0 or binomial_tail(rejected, n, risk / len(rules)) > delta / len(over):
                break
            best = step
        if best is not None and best < STEPS:
            out[at] = best
    return out


def cutoffs(scored: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> dict[tuple[str, str], int]:
    """Cutoffs from all labelled good documents, equal texts counting once; what reaches the driver is a count a class, rule and stratum."""
    good = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1").select("doc_id")
    held = scored.join(good, "doc_id").dropDuplicates(["stratum", "th"])
    each = held.select("stratum", F.explode(F.array(*(
        F.struct(F.lit(r).alias("rule"), F.ceil(F.col(r) * STEPS).cast("int").alias("step")) for r in RULES
    ))).alias("e"))
    rows = each.groupBy("stratum", "e.rule", "e.step").count().collect()
    over: dict[tuple[str, str], list[int]] = {}
    for stratum, rule, step, n in rows:
        over.setdefault((stratum, rule), [0] * (STEPS + 1))[step] += n
    return select_cutoffs(over, risk, delta)


def judge(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """(doc_id, stratum, rules' scores, failed, keep) of every row; failed: the rules broken, in order, with commas."""
    scored = checkpointed(scores(docs))
    found = cutoffs(scored, labels, risk, delta)
    spark = docs.sparkSession
    strata = sorted({s for s, _ in found})
    table = spark.createDataFrame(
        [(s, *(found.get((s, r)) for r in RULES)) for s in strata],
        "stratum string, " + ", ".join(f"cut_{r} int" for r in RULES),
    )  # a row a stratum
    broken = F.concat_ws(",", *(F.when(F.col(r) * STEPS > F.col(f"cut_{r}"), F.lit(r)) for r in RULES))
    judged = scored.join(F.broadcast(table), "stratum", "left").withColumn("failed", broken)
    return judged.select("doc_id", "stratum", *RULES, "failed", (F.col("failed") == "").alias("keep"))


SQL = f"""
WITH scored AS (
  SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t,
    {{share_sign}} AS sign_share, {{share_capital}} AS capital_share, {{share_digit}} AS digit_share,
    1.0 - len(list_distinct(string_split(coalesce(text, ''), chr(10))))::DOUBLE / len(string_split(coalesce(text, ''), chr(10))) AS repeated_lines,
    1.0 - len(list_distinct(string_split(coalesce(text, ''), ' ')))::DOUBLE / len(string_split(coalesce(text, ''), ' ')) AS repeated_words
  FROM documents),
good AS (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1),
once AS (SELECT DISTINCT stratum, t, {", ".join(RULES)} FROM scored JOIN good USING (doc_id)),
held AS (
  {" UNION ALL ".join(f"SELECT stratum, '{r}' AS rule, ceil({r} * {STEPS})::INT AS step FROM once" for r in RULES)}),
sizes AS (SELECT stratum, rule, count(*) AS n FROM held GROUP BY ALL),
tested AS (
  SELECT z.stratum, z.rule, z.n, c.cut, (SELECT count(*) FROM sizes) AS tests,
    (SELECT count(*) FROM held h WHERE h.stratum = z.stratum AND h.rule = z.rule AND h.step > c.cut) AS k
  FROM sizes z, (SELECT unnest(range(0, {STEPS + 1})) AS cut) c),
chances AS (
  SELECT *, CASE WHEN k >= n THEN 1.0 ELSE list_sum(list_transform(range(0, k + 1), lambda j: exp(lgamma(n + 1) - CASE WHEN j > 1 THEN lgamma(j + 1) ELSE 0 END
    - lgamma(n - j + 1) + j * ln({RISK / len(RULES)}) + (n - j) * ln(1 - {RISK / len(RULES)})))) END AS p
  FROM tested),
failing AS (SELECT stratum, rule, max(CASE WHEN p > {DELTA} / tests THEN cut ELSE -1 END) + 1 AS cut FROM chances GROUP BY ALL),
cuts AS (SELECT * FROM failing WHERE cut < {STEPS}),
judged AS (
  SELECT doc_id, stratum, {", ".join(RULES)}, concat_ws(',', {", ".join(f"CASE WHEN {r} * {STEPS} > (SELECT cut FROM cuts c WHERE c.stratum = s.stratum AND c.rule = '{r}') THEN '{r}' END" for r in RULES)}) AS failed
  FROM scored s)
SELECT doc_id, stratum, {", ".join(RULES)}, failed, failed = '' AS keep FROM judged
"""
for _name, _signs in (("sign", SIGNS), ("capital", CAPITALS), ("digit", DIGITS)):
    SQL = SQL.replace(
        f"{{share_{_name}}}",
        f"CASE WHEN length(text) > 0 THEN (length(text) - length(translate(text, '{_signs}', '')))::DOUBLE / length(text) ELSE 0.0 END",
    )
