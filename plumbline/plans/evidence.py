"""Queries on what questions ask for and what the evidence holds: requirements, triplets, document structure.

Each reads whole tables and, beside them, fixed runs or texts (negative ids) that hold every case, as the tables' invented prose holds few.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import text as W
from plumbline.operators import requirements as R
from plumbline.operators import triplets as T
from plumbline.plans.catalogue import ORACLE_SQL, QUERIES, case_sql, query, r6, re2, term
from plumbline.plans.diagnose import turn_windows
from plumbline.sources.tables import table

# ---- requirements ----------------------------------------------------------------------------------------------

#: Questions and chunks: ties, requirements that no chunk holds, partial ones, a cover of two chunks where three hold something, drift.
ASKED = (
    ("What is the refund window? When does the annual plan expire?", ("The refund window is 30 days.", "An annual plan can expire in June.", "Our refund window is long.")),
    ("List the fees, the warranty terms and how to install the sensor; cite the manual section if possible", ("All fees are listed.", "Warranty terms of the sensor", "fees and warranty terms", "Install the sensor with two screws.")),
    ("Why did the pump fail? Compare the old valve with the new valve!", ("The weather was fine.",)),
    ("How many parks are public in Ohio as well as domestic schools", ("Federal education office rules", "How many public parks")),
    ("Which office is eligible?", ()),
    ("", ("No question was asked.",)),
    ("alpha beta gamma delta? alpha beta? gamma delta? epsilon zeta", ("alpha beta", "gamma delta", "alpha beta gamma delta", "epsilon zeta eta", "zeta epsilon")),
)


def fixed_runs(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """The fixed questions and their chunks, as tables."""
    asks = spark.createDataFrame([(-(i + 1), 0, q) for i, (q, _) in enumerate(ASKED)], "conv_id long, turn long, query string")
    holds = spark.createDataFrame([(-(i + 1), 0, r, t) for i, (_, c) in enumerate(ASKED) for r, t in enumerate(c)], "conv_id long, turn long, rank long, text string")
    return asks, holds


def runs_and_chunks(spark: SparkSession, sf: str, chunks: int = 8) -> tuple[DataFrame, DataFrame]:
    """Users' turns as questions, and the assistant's turns among the ``chunks`` before each as its chunks, with the fixed ones."""
    rows = turn_windows(table(spark, sf, "conversations"), chunks).where("role = 'user'")
    own = rows.select("conv_id", "turn", F.explode(F.filter("near", lambda x: x["role"] == "assistant")).alias("c")).select("conv_id", "turn", F.col("c.turn").alias("rank"), F.col("c.text").alias("text"))
    asks, holds = fixed_runs(spark)
    return rows.select("conv_id", "turn", F.col("text").alias("query")).unionByName(asks), own.unionByName(holds)


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


RUNS_SQL = f"""asks AS (
  SELECT conv_id, turn, text AS query FROM conversations WHERE role = 'user'
  UNION ALL SELECT * FROM (VALUES {", ".join(f"({-(i + 1)}, 0, {quoted(q)})" for i, (q, _) in enumerate(ASKED))})),
holds AS (
  SELECT a.conv_id, a.turn, c.turn AS rank, c.text FROM asks a JOIN conversations c ON c.conv_id = a.conv_id AND c.role = 'assistant' AND c.turn BETWEEN a.turn - 8 AND a.turn - 1
  UNION ALL SELECT * FROM (VALUES {", ".join(f"({-(i + 1)}, 0, {r}, {quoted(t)})" for i, (_, c) in enumerate(ASKED) for r, t in enumerate(c))}))"""
SPLIT_SQL = rf"string_split(regexp_replace(regexp_replace(query, '(?i)[?!;\n]+|\.\s+|,\s+and\s+|,\s+|\s+as well as\s+', chr(1), 'g'), '(?i)\s+and\s+((?:what|when|where|who|which|how|why|is|are|does|do|can|list|name|give)\b)', chr(1) || '\1', 'g'), chr(1))"
COVERED_SQL = f"""{RUNS_SQL},
pieces AS (SELECT conv_id, turn, list_filter(list_transform({SPLIT_SQL}, lambda x: trim(x)), lambda x: len({term('x')}) > 0) AS p FROM asks),
reqs AS (SELECT conv_id, turn, unnest(p) AS d, unnest(range(1, len(p) + 1)) AS req FROM pieces),
r AS (SELECT conv_id, turn, req, d, {term('d')} AS terms, {case_sql('d', R.KINDS, R.DEFAULT_KIND)} AS kind,
  CASE WHEN regexp_matches(d, '{re2(R.OPTIONAL)}') THEN 'optional' WHEN regexp_matches(d, '{re2(R.SUPPORTING)}') THEN 'supporting' ELSE 'critical' END AS importance FROM reqs),
m AS (SELECT r.conv_id, r.turn, r.req, h.rank, len(list_intersect(r.terms, {term('h.text')})) / len(r.terms)::DOUBLE AS ratio, list_intersect(r.terms, {term('h.text')}) AS held FROM r JOIN holds h USING (conv_id, turn)),
b AS (SELECT *, max(ratio) OVER (PARTITION BY conv_id, turn, req) AS best FROM m),
t AS (SELECT conv_id, turn, req, best, list(rank ORDER BY rank) AS ties, list_distinct(flatten(list(held))) AS held FROM b WHERE ratio = best AND best > 0 GROUP BY ALL),
covered AS (
  SELECT r.conv_id, r.turn, r.req, r.kind, r.importance, coalesce(t.best, 0.0) AS ratio,
    CASE WHEN coalesce(t.best, 0) > 0.5 THEN 'covered' WHEN coalesce(t.best, 0) >= 0.25 THEN 'partial' ELSE 'missing' END AS status, CASE WHEN t.best >= 0.25 THEN t.ties ELSE [] END AS chunks,
    list_sort(list_filter(r.terms, lambda x: NOT list_contains(coalesce(t.held, []), x))) AS missed
  FROM r LEFT JOIN t USING (conv_id, turn, req))"""


def covered_rows(spark: SparkSession, sf: str) -> DataFrame:
    asks, holds = runs_and_chunks(spark, sf)
    terms = holds.select("conv_id", "turn", "rank", F.col("rank").alias("chunk"), W.terms("text").alias("terms"))
    return R.coverage(R.required(asks, "conv_id", "turn"), terms, "conv_id", "turn")


@query(f"WITH {COVERED_SQL} SELECT conv_id, turn, req, kind, importance, round(ratio, 6) AS ratio, status, array_to_string(chunks, ',') AS chunks, array_to_string(missed, ' ') AS missed FROM covered")
def requirement_coverage(spark, sf):
    """What each question asks for and the chunks before it that hold most of it, all ties; requirements that no chunk holds stay."""
    rows = covered_rows(spark, sf)
    return r6(rows.select("conv_id", "turn", "req", "kind", "importance", "ratio", "status", F.array_join(F.col("chunks").cast("array<string>"), ",").alias("chunks"), F.array_join("missed", " ").alias("missed")), "ratio")


@query(
    f"""WITH RECURSIVE {COVERED_SQL},
s AS (SELECT conv_id, turn, unnest(chunks) AS chunk, req FROM covered WHERE status = 'covered'),
h AS (SELECT conv_id, turn, chunk, list(DISTINCT req) AS reqs FROM s GROUP BY ALL),
base AS (
  SELECT conv_id, turn, count(*) AS n, list(req) FILTER (status = 'covered') AS can, list(req ORDER BY req) FILTER (status <> 'covered') AS uncovered,
    list(req ORDER BY req) FILTER (status = 'missing' AND importance = 'critical') AS critical FROM covered GROUP BY ALL),
g AS (
  SELECT conv_id, turn, can AS rest, CAST([] AS BIGINT[]) AS chosen FROM base WHERE can IS NOT NULL
  UNION ALL
  SELECT conv_id, turn, list_filter(rest, lambda x: NOT list_contains(best.reqs, x)), list_append(chosen, best.chunk) FROM (
    SELECT g.conv_id, g.turn, g.rest, g.chosen, arg_min({{'chunk': h.chunk, 'reqs': h.reqs}}, (-len(list_intersect(h.reqs, g.rest)), h.chunk)) AS best
    FROM g JOIN h ON h.conv_id = g.conv_id AND h.turn = g.turn WHERE len(g.rest) > 0 GROUP BY g.conv_id, g.turn, g.rest, g.chosen))
SELECT b.conv_id, b.turn, b.n, coalesce(array_to_string(b.uncovered, ','), '') AS uncovered, coalesce(array_to_string(b.critical, ','), '') AS critical, coalesce(array_to_string(g.chosen, ','), '') AS chosen
FROM base b LEFT JOIN (SELECT * FROM g WHERE len(rest) = 0) g ON g.conv_id = b.conv_id AND g.turn = b.turn"""
)
def requirement_cover(spark, sf):
    """For each question the fewest chunks, chosen greedily, that hold all that any chunk holds, and the requirements left."""
    rows = R.support(covered_rows(spark, sf), "conv_id", "turn")
    join = lambda c: F.array_join(c.cast("array<string>"), ",")
    return rows.select("conv_id", "turn", "n", join(F.col("uncovered")).alias("uncovered"), join(F.col("critical")).alias("critical"), F.coalesce(join(R.least_cover(F.col("holds"), F.col("can"))), F.lit("")).alias("chosen"))


@query(
    f"""WITH {RUNS_SQL},
c AS (SELECT conv_id, turn, string_agg(text, ' ') AS text FROM holds GROUP BY ALL),
t AS (SELECT a.conv_id, a.turn, {term('a.query')} AS q, coalesce({term('c.text')}, []) AS c FROM asks a LEFT JOIN c ON a.conv_id = c.conv_id AND a.turn = c.turn),
d AS (SELECT *, list_intersect(q, c) AS shared, list_filter(q, lambda x: NOT list_contains(c, x)) AS missing, list_filter(c, lambda x: NOT list_contains(q, x)) AS strange, {list(R.DRIFT_TERMS)} AS words FROM t)
SELECT conv_id, turn, CAST(len(shared) AS INTEGER) AS n_shared, array_to_string(list_sort(missing), ' ') AS missing, CAST(len(strange) AS INTEGER) AS n_strange, round(len(shared) / greatest(len(q), 1)::DOUBLE, 6) AS match,
  round(len(strange) / greatest(len(c), 1)::DOUBLE, 6) AS drift,
  CASE WHEN len(shared) > 0 AND list_has_any(missing, words) AND list_has_any(strange, words) AND len(shared) / greatest(len(q), 1)::DOUBLE <= 0.75 AND len(strange) / greatest(len(c), 1)::DOUBLE >= 0.25 THEN 'fail' ELSE 'pass' END AS status
FROM d"""
)
def scope_drift(spark, sf):
    """Terms that question and chunks share, miss and add, and whether words of scope changed places."""
    asks, holds = runs_and_chunks(spark, sf)
    terms = holds.select("conv_id", "turn", W.terms("text").alias("t")).groupBy("conv_id", "turn").agg(F.array_distinct(F.flatten(F.collect_list("t"))).alias("c"))
    rows = asks.select("conv_id", "turn", F.coalesce(W.terms("query"), F.array().cast("array<string>")).alias("q")).join(terms, ["conv_id", "turn"], "left")
    d = R.drift(F.col("q"), F.coalesce("c", F.array().cast("array<string>")))
    out = rows.select("conv_id", "turn", d.alias("d")).select("conv_id", "turn", F.size("d.shared").alias("n_shared"), F.array_join("d.missing", " ").alias("missing"), F.size("d.strange").alias("n_strange"), "d.match", "d.drift", "d.status")
    return r6(out, "match", "drift")


# ---- triplets --------------------------------------------------------------------------------------------------

#: Claims and chunks, with the label of each claim: values and polarity that clash, near misses of subject, predicate and object, several triplets in one claim.
CLAIMED = (
    ("The annual plan costs $40 per month.", ("The annual plan costs $40.",), "entailed"),
    ("The annual plan costs $40 per month.", ("The annual plan costs $45 per month.",), "contradicted"),
    ("The annual plan costs $40 per month.", ("The monthly plan costs $45 per month.",), "unsupported"),
    ("Refunds are allowed within 30 days.", ("Refunds are not allowed within 30 days.",), "contradicted"),
    ("Refunds are not allowed.", ("Refunds are not allowed.", "Refunds are paid by card."), "entailed"),
    ("Acme founded the museum in 1999 and sells maps.", ("Acme founded the museum in 1999.", "Acme sells maps and books."), "entailed"),
    ("Acme founded the museum in 1999 and sells globes.", ("Acme founded the museum in 1999.", "Acme sells maps and books."), "unsupported"),
    ("Acme founded the museum in 1999 and sells globes.", ("Acme founded the museum in 1998.",), "contradicted"),
    ("Yesterday, again!", ("The annual plan costs $40.",), "abstain"),
    ("The office is located in Paris.", (), "unsupported"),
)


@query()
def claim_triplets(spark, sf):
    """Triplets of every document, and of the fixed claims (negative ids): how many of each predicate, how many denied, with values and with qualifiers."""
    fixed = spark.createDataFrame([(-(i + 1), c) for i, (c, _, _) in enumerate(CLAIMED)], "doc_id long, text string")
    found = T.extracted(table(spark, sf, "documents").select("doc_id", "text").unionByName(fixed), "doc_id").select("doc_id", "t.*")
    one = lambda c: F.sum(c.cast("long"))
    return found.groupBy((F.col("doc_id") < 0).alias("fixed"), "predicate").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("key").alias("n_subjects"), one(F.col("negated")).alias("n_negated"), one(F.size("values") > 0).alias("n_valued"), one(F.size("qualifiers") > 0).alias("n_qualified")
    )


@query()
def triplet_verification(spark, sf):
    """Every sentence of an answer against the triplets of the turns before its question, and the fixed claims (negative ids)."""
    rows = turn_windows(table(spark, sf, "conversations"), 8).where("role = 'user' AND next_role = 'assistant' AND next_turn = turn + 1")
    claims = rows.select("conv_id", "turn", F.posexplode(W.sentences("final_answer")).alias("claim", "text"))
    chunks = rows.select("conv_id", "turn", F.explode(F.filter("near", lambda x: x["role"] == "assistant")).alias("c")).select("conv_id", "turn", F.col("c.turn").alias("chunk"), F.col("c.text").alias("text"))
    fixed = spark.createDataFrame([(-(i + 1), 0, 0, c) for i, (c, _, _) in enumerate(CLAIMED)], "conv_id long, turn long, claim int, text string")
    held = spark.createDataFrame([(-(i + 1), 0, k, t) for i, (_, ts, _) in enumerate(CLAIMED) for k, t in enumerate(ts)], "conv_id long, turn long, chunk long, text string")
    out = T.verified(claims.unionByName(fixed), chunks.unionByName(held), "conv_id", "turn")
    join = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return out.select("conv_id", "turn", "claim", "n_triplets", "label", join("supporting"), join("contradicting"))


# ---- tables in texts -------------------------------------------------------------------------------------------

#: Texts with blocks and near misses: one line alone, a rule without a header, ragged rows, two blocks, prose with pipes.
TABLED = (
    "| Plan | Price |\n|---|---|\n| Basic | 5 |\n| Plus | 9 |", "Intro\n| a | b |\nOutro", "Name\tAge\nAnn\t31\nBob\t40\n\nx  y  z\n1  2  3\n4  5  6  7", "|---|\n|---|", "either | or | both", "a  b\nc  d", "", "| 1 | 2 |\n| 3 | 4 |\nend\n| x |\n| y |",
)


def order_tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """An order's lines as a known table, and a chunk of it in one of six forms by the order's number: pipes, tabs, aligned columns, one line, numbers without structure, or no table at all.

    Strategies follow the number, too; some chunks do not name their table.
    """
    from plumbline.operators import tables as B

    key = F.col("l_orderkey")
    line = F.struct("l_linenumber", F.col("l_partkey").cast("string").alias("p"), F.col("l_quantity").cast("int").cast("string").alias("q"), F.col("l_returnflag").alias("f"))
    rows = table(spark, sf, "lineitem").groupBy(key.alias("doc_id")).agg(F.array_sort(F.collect_list(line)).alias("r"))
    joined = lambda sep, ends="": F.array_join(F.transform("r", lambda x: F.concat(F.lit(ends), F.concat_ws(sep, x["p"], x["q"], x["f"]), F.lit(ends[::-1]))), "\n")
    form = F.pmod(F.col("doc_id"), F.lit(6))
    text = (
        F.when(form == 0, F.concat(F.lit("Order lines\n| Part | Quantity | Flag |\n|---|---|---|\n"), joined(" | ", "| ")))
        .when(form == 1, F.concat(F.lit("Part\tQuantity\tFlag\n"), joined("\t")))
        .when(form == 2, joined("  "))
        .when(form == 3, F.concat(F.lit("Part Quantity Flag of this order are "), F.array_join(F.transform("r", lambda x: F.concat_ws(" ", x["p"], x["q"], x["f"])), " ")))
        .when(form == 4, F.array_join(F.transform("r", lambda x: F.concat_ws("\n", x["p"], x["q"])), "\n"))
        .otherwise("Nothing of the table is here.")
    )
    strategy = F.element_at(F.array(*(F.lit(s[0]) for s in B.STRATEGIES)), (F.pmod(F.col("doc_id"), F.lit(11)) + 1).cast("int"))
    base = rows.select("doc_id", "r", strategy.alias("strategy"), text.alias("text"))
    tables = base.select("doc_id", F.lit("t0").alias("table_id"), F.array(*map(F.lit, ("Part", "Quantity", "Flag"))).alias("headers"), "strategy")
    ids = F.when((form < 4) & (F.pmod(F.col("doc_id"), F.lit(12)) != 9), F.array(F.lit("t0"))).otherwise(F.array().cast("array<string>"))
    return tables, base.select("doc_id", F.lit("c0").alias("chunk"), "text", ids.alias("source_table_ids"), "strategy")


ORDER_TEXT_SQL = """lines AS (SELECT l_orderkey AS doc_id, list({'n': l_linenumber, 'p': CAST(l_partkey AS VARCHAR), 'q': CAST(CAST(l_quantity AS INTEGER) AS VARCHAR), 'f': l_returnflag} ORDER BY l_linenumber, CAST(l_partkey AS VARCHAR), CAST(CAST(l_quantity AS INTEGER) AS VARCHAR), l_returnflag) AS r FROM lineitem GROUP BY 1),
base AS (SELECT doc_id, CASE doc_id % 6
  WHEN 0 THEN 'Order lines' || chr(10) || '| Part | Quantity | Flag |' || chr(10) || '|---|---|---|' || chr(10) || array_to_string(list_transform(r, lambda x: '| ' || x.p || ' | ' || x.q || ' | ' || x.f || ' |'), chr(10))
  WHEN 1 THEN 'Part' || chr(9) || 'Quantity' || chr(9) || 'Flag' || chr(10) || array_to_string(list_transform(r, lambda x: x.p || chr(9) || x.q || chr(9) || x.f), chr(10))
  WHEN 2 THEN array_to_string(list_transform(r, lambda x: x.p || '  ' || x.q || '  ' || x.f), chr(10))
  WHEN 3 THEN 'Part Quantity Flag of this order are ' || array_to_string(list_transform(r, lambda x: x.p || ' ' || x.q || ' ' || x.f), ' ')
  WHEN 4 THEN array_to_string(list_transform(r, lambda x: x.p || chr(10) || x.q), chr(10))
  ELSE 'Nothing of the table is here.' END AS text FROM lines)"""


def _texts_with_tables(spark, sf):
    _, chunks = order_tables(spark, sf)
    fixed = spark.createDataFrame([(-(i + 1), t) for i, t in enumerate(TABLED)], "doc_id long, text string")
    # order numbers and document ids are told apart by their source
    docs = table(spark, sf, "documents").select(F.lit("documents").alias("source"), "doc_id", "text")
    return docs.unionByName(chunks.select(F.lit("orders").alias("source"), "doc_id", "text")).unionByName(fixed.select(F.lit("fixed").alias("source"), "doc_id", "text"))


@query(
    rf"""WITH {ORDER_TEXT_SQL},
texts AS (SELECT 'documents' AS source, doc_id, text FROM documents UNION ALL SELECT 'orders', doc_id, text FROM base
  UNION ALL SELECT 'fixed', * FROM (VALUES {", ".join(f"({-(i + 1)}, {quoted(t)})" for i, t in enumerate(TABLED))})),
u AS (SELECT source, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS pos FROM texts),
k AS (SELECT *, CASE WHEN regexp_matches(line, '^\s*\|.+\|\s*$') THEN 'pipe' WHEN contains(line, chr(9)) THEN 'tab' WHEN regexp_matches(line, '^\S+(?:[ \t]{{2,}}\S+){{2,}}\s*$') THEN 'aligned' ELSE '' END AS kind FROM u),
g AS (SELECT *, pos - row_number() OVER (PARTITION BY source, doc_id, kind ORDER BY pos) AS island FROM k WHERE kind <> ''),
c AS (SELECT *, regexp_matches(line, '^\s*\|[ \t:|-]+\|\s*$') AS rule, row_number() OVER (PARTITION BY source, doc_id, kind, island ORDER BY pos) AS nth,
  CASE kind WHEN 'pipe' THEN string_split(regexp_replace(line, '^\s*\||\|\s*$', '', 'g'), '|') WHEN 'tab' THEN string_split(line, chr(9)) ELSE string_split_regex(trim(line), '[ \t]{{2,}}') END AS cells FROM g),
w AS (SELECT source, doc_id, kind, island, len(cells) AS width, count(*) AS n FROM c WHERE NOT rule GROUP BY ALL),
m AS (SELECT source, doc_id, kind, island, arg_max(width, (n, width)) AS n_cols, max(n) AS most, sum(n) AS body FROM w GROUP BY ALL),
b AS (SELECT source, doc_id, kind, island, min(pos) AS first, max(pos) AS last, bool_or(nth = 2 AND rule) AS ruled, bool_or(nth = 1 AND rule) AS starts_ruled, bool_or(nth = 1 AND regexp_matches(line, '[0-9]')) AS first_digit,
  bool_or(regexp_matches(line, '[0-9]')) AS any_digit, any_value(cells) FILTER (nth = 1) AS top FROM c GROUP BY ALL HAVING count(*) > 1),
h AS (SELECT b.*, m.n_cols, m.most, m.body, (ruled OR (NOT first_digit AND any_digit)) AND NOT starts_ruled AS headed FROM b LEFT JOIN m USING (source, doc_id, kind, island))
SELECT source, doc_id, CAST(first AS INTEGER) AS first, CAST(last AS INTEGER) AS last, kind, CAST(coalesce(body, 0) - CAST(headed AS INTEGER) AS INTEGER) AS n_rows, CAST(n_cols AS INTEGER) AS n_cols, round(most / body::DOUBLE, 6) AS width_share,
  CASE WHEN headed THEN array_to_string(list_transform(top, lambda x: lower(trim(x))), ',') ELSE '' END AS header
FROM h"""
)
def table_blocks(spark, sf):
    """Table blocks of every document, of every order's rendered lines and of fixed texts (negative ids)."""
    from plumbline.operators import tables as B

    rows = B.blocks(_texts_with_tables(spark, sf), "source", "doc_id")
    return r6(rows.withColumn("header", F.array_join("header", ",")), "width_share")


def _flag_sql(flag: int) -> str:
    from plumbline.operators import tables as B

    return "(" + " OR ".join(f"strategy = '{s[0]}'" for s in B.STRATEGIES if s[flag + 1]) + ")"


@query(
    rf"""WITH {ORDER_TEXT_SQL},
names AS (SELECT ['unknown', 'fixed_token', 'recursive_text', 'sentence', 'hierarchical', 'markdown_header', 'semantic', 'table_aware', 'parent_child', 'summary', 'late_chunking'] AS s),
t AS (SELECT doc_id, text, s[doc_id % 11 + 1] AS strategy, doc_id % 6 < 4 AND doc_id % 12 <> 9 AS named, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS ls FROM base, names),
w AS (SELECT *, list_filter(list_transform(string_split(text, chr(10)), lambda x: len(list_filter(string_split_regex(x, '\s+'), lambda y: y <> ''))), lambda n: n >= 3) AS widths,
  list_filter(string_split_regex(text, '\s+'), lambda y: y <> '') AS words, regexp_extract_all(text, '[A-Za-z][A-Za-z./()-]*|[0-9]+(?:[.,][0-9]+)?') AS tok FROM t),
s AS (SELECT *, CASE WHEN regexp_matches(text, '(?m)^\s*\|.+\|\s*$') THEN 1.0 ELSE (CAST(contains(text, chr(9)) AS INTEGER) + CAST(len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^\S+(?:[ \t]{{2,}}\S+){{2,}}\s*$'))) >= 2 AS INTEGER)
    + CAST(CASE WHEN len(widths) >= 3 THEN list_max(list_transform(widths, lambda v: len(list_filter(widths, lambda u: u = v)))) / len(widths)::DOUBLE ELSE 0 END >= 0.6 AS INTEGER)) / 5.0::DOUBLE END AS structure,
  CASE WHEN named THEN (CAST(contains(lower(text), 'part') AS INTEGER) + CAST(contains(lower(text), 'quantity') AS INTEGER) + CAST(contains(lower(text), 'flag') AS INTEGER)) / 3.0::DOUBLE END AS headed FROM w),
f AS (SELECT *, structure < 0.7 AS low, headed < 0.5 AS bare, {_flag_sql(0)} AS kt, {_flag_sql(1)} AS kh, {_flag_sql(2)} AS ke, {_flag_sql(3)} AS mf, {_flag_sql(4)} AS np FROM s WHERE NOT {_flag_sql(5)}),
known AS (
  SELECT doc_id, 't0' AS table_id, CASE WHEN named THEN 'c0' END AS chunk, CASE WHEN named THEN 'weak_table' ELSE 'lost_table' END AS "check",
    CASE WHEN NOT named THEN 'fail' WHEN kt AND low THEN 'fail' ELSE 'warn' END AS severity,
    CASE WHEN NOT named THEN 0.9 WHEN kt THEN least(0.95, greatest(0.7, 1 - structure)) WHEN mf THEN least(0.9, greatest(0.6, 1 - headed)) ELSE least(0.9, greatest(0.6, 1 - structure)) END AS confidence
  FROM f WHERE (NOT named AND (np OR kt OR ke)) OR (named AND CASE WHEN kt THEN low OR (kh AND bare) WHEN mf THEN kh AND bare ELSE low OR (kh AND bare) END)),
loose AS (SELECT *, len(ls) = 1 AND len(tok) >= 8 AND len(list_filter(tok, lambda x: regexp_matches(x, '[0-9]'))) >= 2 AND len(list_filter(tok, lambda x: regexp_matches(x, '[A-Za-z]'))) >= 6
    AND len(list_filter(tok[1:3], lambda x: NOT regexp_matches(x, '^[A-Z][^0-9]*$'))) = 0 AND len(list_filter(tok[4:], lambda x: regexp_matches(x, '[0-9]'))) > 0 AND len(list_filter(tok[4:], lambda x: regexp_matches(x, '[A-Za-z]'))) > 0 AS squeezed,
    len(list_filter(words, lambda x: regexp_matches(x, '[0-9]'))) / greatest(len(words), 1)::DOUBLE AS digits FROM f WHERE NOT named AND structure < 0.3),
plain AS (
  SELECT doc_id, NULL AS table_id, 'c0' AS chunk, CASE WHEN squeezed THEN 'collapsed_table' ELSE 'dense_numbers' END AS "check", CASE WHEN squeezed AND NOT mf THEN 'fail' ELSE 'warn' END AS severity, CASE WHEN squeezed THEN 0.85 ELSE 0.55 END AS confidence
  FROM loose WHERE squeezed OR (digits >= 0.3 AND len(ls) >= 4))
SELECT doc_id, table_id, chunk, "check", severity, round(CAST(confidence AS DOUBLE), 6) AS confidence FROM known UNION ALL SELECT doc_id, table_id, chunk, "check", severity, round(CAST(confidence AS DOUBLE), 6) FROM plain"""
)
def table_findings(spark, sf):
    """What happened to every order's table in its chunk: lost, weak, collapsed into a line, or dense numbers."""
    from plumbline.operators import tables as B

    return r6(B.table_findings(*order_tables(spark, sf)).select("doc_id", "table_id", "chunk", "check", "severity", "confidence"), "confidence")


# ---- outlines ----------------------------------------------------------------------------------------------------


#: Order lines that one task reads as numbered texts: its sorts and windows hold a few hundred bytes a line.
LINES_A_TASK = 200_000


def order_outlines(spark: SparkSession, sf: str) -> DataFrame:
    """An order's lines as a numbered text: the part's number decides how a line begins, some are tables' titles or ends.

    Orders are dealt to as many tasks as their lines need, so that a task's memory does not grow with the table.
    """
    n, part = F.col("l_linenumber").cast("string"), F.pmod(F.col("l_partkey"), F.lit(16))
    begin = F.when(part < 4, F.concat(n, F.lit(". "))).when(part < 6, F.lit("(B) ")).when(part < 9, F.concat(F.lit("("), n, F.lit(") "))).when(part < 11, F.lit("(ii) ")).when(part < 12, F.lit("c) ")).when(part < 14, F.lit("")).when(part < 15, F.lit("Annexure ")).otherwise("Copy to ")
    line = F.struct("l_linenumber", F.concat(begin, F.lit("part "), F.col("l_partkey").cast("string"), F.lit("  of "), F.col("l_returnflag")).alias("s"))
    lines = table(spark, sf, "lineitem")
    lines = lines.repartition(max(8, math.ceil(lines.count() / LINES_A_TASK)), "l_orderkey")
    rows = lines.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.array_sort(F.collect_list(line)).alias("r"))
    head = F.when(F.col("doc_id") % 3 == 0, F.lit("LINES DEPARTMENT\n1. before the body\nORDER:\n")).otherwise(F.lit(""))
    return rows.select("doc_id", F.concat(head, F.array_join(F.transform("r", lambda x: x["s"]), "\n")).alias("text"))


OUTLINE_SQL = r"""l AS (SELECT l_orderkey AS doc_id, l_linenumber AS n, CASE WHEN l_partkey % 16 < 4 THEN l_linenumber || '. ' WHEN l_partkey % 16 < 6 THEN '(B) ' WHEN l_partkey % 16 < 9 THEN '(' || l_linenumber || ') ' WHEN l_partkey % 16 < 11 THEN '(ii) '
    WHEN l_partkey % 16 < 12 THEN 'c) ' WHEN l_partkey % 16 < 14 THEN '' WHEN l_partkey % 16 < 15 THEN 'Annexure ' ELSE 'Copy to ' END || 'part ' || l_partkey || '  of ' || l_returnflag AS s FROM lineitem),
x AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 3 ELSE 0 END + row_number() OVER (PARTITION BY doc_id ORDER BY n, s) - 1 AS pos, regexp_replace(s, '\s+', ' ', 'g') AS s FROM l),
e AS (SELECT *, CASE WHEN regexp_matches(s, '^Annexure') THEN 'title' WHEN regexp_matches(s, '^Copy to') THEN 'end' WHEN regexp_matches(s, '^[0-9]+\.') THEN 'top' WHEN regexp_matches(s, '^\([A-Z]+\)') THEN 'upper'
    WHEN regexp_matches(s, '^\([0-9]+\)') THEN 'numeric' WHEN regexp_matches(s, '^\([ivx]+\)') THEN 'roman' WHEN regexp_matches(s, '^[a-z]\)') THEN 'alpha' ELSE '' END AS kind FROM x),
v AS (SELECT *, coalesce(max(CASE WHEN kind <> '' THEN pos END) OVER (PARTITION BY doc_id ORDER BY pos), -1) AS event FROM e),
t AS (SELECT doc_id, event AS pos, string_agg(CASE WHEN kind = '' THEN s ELSE regexp_replace(s, '^\S+ ', '') END, ' ' ORDER BY pos) AS text, max(kind) AS kind FROM v WHERE event >= 0 GROUP BY ALL),
a AS (SELECT t.*, coalesce((SELECT arg_max(u.kind, u.pos) FROM t u WHERE u.doc_id = t.doc_id AND u.pos <= t.pos AND u.kind IN ('title', 'end', 'top')), '') = 'title' AS in_table, (SELECT count(*) FROM t u WHERE u.doc_id = t.doc_id AND u.pos <= t.pos AND u.kind = 'end') AS section FROM t),
m AS (SELECT *, lag(kind) OVER (PARTITION BY doc_id, section ORDER BY pos) AS before FROM a WHERE NOT in_table AND kind NOT IN ('title', 'end')),
d AS (SELECT *, CASE kind WHEN 'top' THEN 1 WHEN 'upper' THEN 2 WHEN 'numeric' THEN CASE WHEN before = 'upper' THEN 3 ELSE 2 END WHEN 'roman' THEN CASE WHEN before = 'alpha' THEN 4 ELSE 3 END ELSE CASE WHEN before = 'numeric' THEN 4 ELSE 3 END END AS depth FROM m)"""


@query(
    f"""WITH {OUTLINE_SQL}
SELECT d.doc_id, CAST(d.pos AS INTEGER) AS pos, CAST((SELECT max(u.pos) FROM d u WHERE u.doc_id = d.doc_id AND u.section = d.section AND u.pos < d.pos AND u.depth < d.depth) AS INTEGER) AS parent_pos, CAST(d.depth AS INTEGER) AS depth, d.kind, d.text FROM d"""
)
def outline_nodes(spark, sf):
    """The node tree of every order's numbered text: nearest earlier marker of lower depth as parent."""
    from plumbline.operators import outline

    return outline.nodes(order_outlines(spark, sf), "doc_id").select("doc_id", "pos", "parent_pos", "depth", "kind", "text")


@query(
    f"""WITH RECURSIVE {OUTLINE_SQL},
p AS MATERIALIZED (SELECT d.doc_id, d.pos, d.text, (SELECT max(u.pos) FROM d u WHERE u.doc_id = d.doc_id AND u.section = d.section AND u.pos < d.pos AND u.depth < d.depth) AS parent FROM d),
b AS (SELECT doc_id, pos AS top, pos, text FROM p UNION ALL SELECT b.doc_id, b.top, p.pos, p.text FROM b JOIN p ON p.doc_id = b.doc_id AND p.parent = b.pos)
SELECT doc_id, CAST(top AS INTEGER) AS pos, CAST(count(*) AS INTEGER) AS n_nodes, md5(string_agg(text, chr(10) ORDER BY pos)) AS digest FROM b GROUP BY doc_id, top"""
)
def outline_chunks(spark, sf):
    """One chunk a node: its text and that of all nodes below it."""
    from plumbline.operators import outline

    return outline.chunks(order_outlines(spark, sf), "doc_id").select("doc_id", "pos", "n_nodes", F.md5(F.col("chunk").cast("binary")).alias("digest"))


#: Texts that show a hierarchy run together, and near misses.
FLAT = ("Chapter 1 says (1) a (2) b (3) c", "1. One 2. Two 3. Three 4. Four", "Section 1, section 1 and Part II", "Part I, Rule 2 and Section 3", "(1) a (2) b (3) c", "Chapter one (1) a (2) b (3) c", "plain")


@query(
    rf"""WITH names AS (SELECT ['unknown', 'fixed_token', 'recursive_text', 'sentence', 'hierarchical', 'markdown_header', 'semantic', 'table_aware', 'parent_child', 'summary', 'late_chunking'] AS s),
o AS (SELECT l_orderkey AS doc_id, 'c' || l_linenumber AS chunk, l_linenumber AS n, l_partkey % 7 AS f, l_suppkey % 3 = 0 AS bare, s[l_orderkey % 11 + 1] AS strategy, l_partkey % 5 <> 0 AS sourced, l_suppkey % 4 = 1 AS crosses FROM lineitem, names),
c AS (SELECT *, [{", ".join(quoted(t) for t in FLAT)}][f + 1] AS text FROM o),
k AS (SELECT *, len(list_distinct(list_transform(regexp_extract_all(text, '(?i)\b(part\s+[ivxlcdm]+|chapter\s+[0-9]+|section\s+[0-9]+|rule\s+[0-9]+|annexure\s+[a-z0-9]+)\b'), lambda x: lower(x)))) AS h, len(regexp_extract_all(text, '\([0-9]+\)|\b[0-9]+\.\s+[A-Z][A-Za-z]+')) AS q, strategy IN ('hierarchical', 'markdown_header') AS keeps FROM c)
SELECT doc_id, chunk, 'flattened_hierarchy' AS "check", CASE WHEN keeps AND h > 0 AND q >= 3 THEN 'fail' ELSE 'warn' END AS severity, NULL::DOUBLE AS share FROM k WHERE bare AND strategy <> 'summary' AND (h >= 3 OR q >= 4 OR (h > 0 AND q >= 3))
UNION ALL SELECT doc_id, chunk, 'crosses_section', 'warn', NULL FROM k WHERE crosses AND keeps
UNION ALL SELECT doc_id, NULL, 'missing_paths', 'warn', round(avg(CAST(bare AS DOUBLE)), 6) FROM k WHERE sourced AND keeps GROUP BY doc_id HAVING avg(CAST(bare AS DOUBLE)) > 0.2 + 1e-9"""
)
def hierarchy_findings(spark, sf):
    """Order lines as chunks of fixed texts, strategies by the order's number: hierarchies run into text, chunks over section bounds, too few paths."""
    from plumbline.operators import outline
    from plumbline.operators import tables as B

    rows = table(spark, sf, "lineitem")
    at = lambda xs, i: F.element_at(F.array(*map(F.lit, xs)), (i + 1).cast("int"))
    bare = F.pmod("l_suppkey", F.lit(3)) == 0
    chunks = rows.select(
        F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("c"), "l_linenumber").alias("chunk"), at(FLAT, F.pmod("l_partkey", F.lit(7))).alias("text"), F.when(bare, F.array().cast("array<string>")).otherwise(F.array(F.lit("A"))).alias("path"),
        at([s[0] for s in B.STRATEGIES], F.pmod("l_orderkey", F.lit(11))).alias("strategy"), (F.pmod("l_partkey", F.lit(5)) != 0).alias("sourced"), (F.pmod("l_suppkey", F.lit(4)) == 1).alias("crosses"),
    )
    return r6(outline.hierarchy_findings(chunks), "share")
