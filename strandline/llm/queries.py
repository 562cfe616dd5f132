"""The operators over the test tables with production parameters, and their DuckDB twins where SQL can say them."""

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from catalog.registry import Catalog
from strandline.llm import (
    conversation_repair,
    decontaminate,
    exact_dedup,
    hard_negatives,
    html_text,
    lm_score,
    mixing,
    pii,
    simhash,
    suffix_dedup,
    token_count,
    toxicity,
    warc,
)

CATALOG = Catalog()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# 1: mixing


def mix_levels() -> dict[str, Column]:
    """The domain comes from the last digit of the source."""
    digit = F.right(F.col("source"), F.lit(1))
    domain = F.when(digit.isin("0", "1", "2", "3"), "web").when(digit.isin("4", "5", "6"), "books").otherwise("forum")
    return {"domain": domain, "lang": F.col("lang"), "source": F.col("source")}


MIX_WEIGHTS = {
    "domain": {"web": 5, "books": 3, "forum": 2},
    "lang": {"en": 6, "de": 2, "fr": 2},
    "source": {"src0": 3, "src4": 2},
}
MIX_EPOCHS = 2
MIX_SEED = 7


def mix_documents(documents: DataFrame) -> DataFrame:
    """Half of all tokens, drawn by the weights."""
    return mixing.mix(documents, mix_levels(), MIX_WEIGHTS, F.expr("total div 2"), MIX_EPOCHS, MIX_SEED)


def _level_sql(name: str, parents: str, level: str, above: str, weight: str) -> str:
    return f"""
{name}_n AS (
  SELECT {parents}, {level}, sum(tokens) * {MIX_EPOCHS} AS capacity, any_value({weight}) AS weight
  FROM leaves GROUP BY ALL),
{name}_a AS (
  SELECT n.*, budget,
    budget - coalesce(sum(capacity) OVER (PARTITION BY {parents} ORDER BY capacity::DOUBLE / weight, {level}
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_over,
    sum(weight) OVER (PARTITION BY {parents} ORDER BY capacity::DOUBLE / weight, {level}
      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights
  FROM {name}_n n JOIN {above} USING ({parents})),
{name}_b AS (SELECT *, capacity * weights <= left_over * weight AS is_full FROM {name}_a),
{name}_c AS (
  SELECT *, budget - sum(CASE WHEN is_full THEN capacity ELSE 0 END) OVER (PARTITION BY {parents}) AS rest,
    sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER (PARTITION BY {parents}) AS open_weights FROM {name}_b),
{name} AS (
  SELECT {parents}, {level}, CASE WHEN is_full THEN capacity ELSE rest * weight // open_weights END AS budget
  FROM {name}_c)"""


def _weight_sql(level: str) -> str:
    return f"CASE {' '.join(f'WHEN {level} = {node!r} THEN {w}' for node, w in MIX_WEIGHTS[level].items())} ELSE 1 END"


def mix_sql(documents: str = "documents") -> str:
    return f"""
WITH counted AS (
  SELECT 0 AS root, doc_id, CASE WHEN right(source, 1) IN ('0', '1', '2', '3') THEN 'web'
      WHEN right(source, 1) IN ('4', '5', '6') THEN 'books' ELSE 'forum' END AS domain,
    coalesce(lang, '-') AS lang, coalesce(source, '-') AS source,
    len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS n_tokens
  FROM {documents}),
drawn AS (SELECT * FROM counted WHERE n_tokens > 0),
leaves AS (SELECT root, domain, lang, source, sum(n_tokens) AS tokens FROM drawn GROUP BY ALL),
start AS (SELECT root, least(sum(tokens) // 2, sum(tokens) * {MIX_EPOCHS}) AS budget FROM leaves GROUP BY root),
{_level_sql("domains", "root", "domain", "start", _weight_sql("domain"))},
{_level_sql("langs", "root, domain", "lang", "domains", _weight_sql("lang"))},
{_level_sql("sources", "root, domain, lang", "source", "langs", _weight_sql("source"))},
plan AS (
  SELECT l.*, budget // tokens AS whole, budget % tokens AS rest
  FROM leaves l JOIN sources USING (root, domain, lang, source)),
ordered AS (
  SELECT d.*, whole, rest, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source
    ORDER BY md5('{MIX_SEED}:' || whole || ':' || doc_id), doc_id, n_tokens
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier
  FROM drawn d JOIN plan USING (root, domain, lang, source)),
taken AS (
  SELECT doc_id, domain, lang, source, n_tokens, unnest(range(0, whole::BIGINT)) AS epoch, n_tokens AS take_tokens
  FROM ordered
  UNION ALL
  SELECT doc_id, domain, lang, source, n_tokens, whole, least(n_tokens, rest - earlier) FROM ordered
  WHERE rest > earlier)
SELECT doc_id, domain, lang, source, n_tokens::BIGINT AS n_tokens, epoch::INTEGER AS epoch,
  take_tokens::BIGINT AS take_tokens FROM taken"""


@CATALOG.add("op1_mix_sources", mix_sql())
def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(table(spark, sf_dir, "documents"))


# 2: main text of pages


@CATALOG.add("op2_main_text")
def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.extract(table(spark, sf_dir, "pages"), html_text.default_model(spark))
    return found.withColumn("n_chars", F.length("text").cast("long"))


# 3: SimHash


@CATALOG.add("op3_simhash_groups")
def op3_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"))


# 4: personal data


@CATALOG.add("op4_personal_data")
def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans"
    )


# 5: WARC


@CATALOG.add("op5_warc_archives")
def op5_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.archive_and_read(table(spark, sf_dir, "pages"), min_revisit_bytes=0)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


# 6: benchmark decontamination


@CATALOG.add("op6_benchmark_copies")
def op6_benchmark_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# 7: toxicity


def toxicity_lexicon(spark: SparkSession, sf_dir: str) -> toxicity.Lexicon:
    return toxicity.learn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@CATALOG.add("op7_toxicity")
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), toxicity_lexicon(spark, sf_dir))


# 8: repeated passages


@CATALOG.add("op8_repeated_passages")
def op8_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


# 9: exact duplicates

EXACT_SQL = r"""
WITH norm AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_points,
    regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER same AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
  doc_id = first_value(doc_id) OVER same AS kept, sha256(norm) AS text_sha256
FROM norm WINDOW same AS (PARTITION BY norm ORDER BY n_points DESC, doc_id)"""


@CATALOG.add("op9_exact_duplicates", EXACT_SQL)
def op9_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


# 10: language model scores


@CATALOG.add("op10_lm_scores")
def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.lm_scores(table(spark, sf_dir, "documents"))


# 11: token counts

VOCABULARY_FILE = "byte_bpe_50k.json"


@CATALOG.add("op11_token_counts")
def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = token_count.Vocabulary.load(public_tokenizers.path(VOCABULARY_FILE))
    return token_count.with_limit(token_count.token_counts(table(spark, sf_dir, "documents"), vocabulary))


# 12: repair of conversations


def _crc32_sql(text: str) -> str:
    """Bit by bit: DuckDB has no function for it."""
    step = "lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    digits = f"hex(encode({text}))"
    byte = f"('0x' || substr({digits}, 2 * p + 1, 2))::BIGINT"
    codes = f"list_transform(range(length({digits}) // 2), lambda p: {byte})"
    whole = f"list_reduce({codes}, lambda s, b: list_reduce(range(8), {step}, xor(s, b)), 4294967295::BIGINT)"
    return f"xor({whole}, 4294967295)"


# The four places of the grammar: nothing yet (o), after a system turn (s), after a user (u), after an assistant (a).
# A value is [cost, audit], so that the smaller one comes first in a sorted list; null: not reached.
def _least_sql(*values: str) -> str:
    return f"list_min([{', '.join(values)}])"


def _step_sql(place: str, cost: str, letter: str) -> str:
    return f"CASE WHEN {place} IS NOT NULL THEN {{'c': {place}.c + {cost}, 'e': {place}.e || '{letter}'}} END"


def _edits_sql() -> str:
    late = "3 * is_truncated::INT"
    keep = lambda place: f"CASE WHEN NOT gone THEN {_step_sql(place, late, 'K')} END"  # noqa: E731
    rerole = lambda place: f"CASE WHEN NOT gone THEN {_step_sql(place, f'3 + {late}', 'R')} END"  # noqa: E731
    role = lambda r, value: f"CASE WHEN initial = '{r}' THEN {value} END"  # noqa: E731
    starts = ("o", "s", "ia")
    return f"""
      {_step_sql("o", "4", "D")} AS o,
      {_least_sql(_step_sql("s", "4", "D"), role("s", keep("o")))} AS s,
      {_least_sql(_step_sql("iu", "4", "D"), *[role("u", keep(p)) for p in starts], *[rerole(p) for p in starts])} AS u,
      {_least_sql(_step_sql("ia", "4", "D"), role("a", keep("iu")), rerole("iu"))} AS a"""


def _inserted_sql(columns: str, source: str) -> str:
    """With a user inserted, and then an assistant."""
    iu = _least_sql("u", *[_step_sql(p, "3", "I") for p in ("o", "s", "a")])
    return f"SELECT *, {_least_sql('a', _step_sql('iu', '3', 'I'))} AS ia FROM (SELECT {columns}, {iu} AS iu FROM {source})"


REPAIR_SQL = rf"""
WITH RECURSIVE base AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {_crc32_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS draw
  FROM conversations),
hurt AS (
  SELECT conv_id, turn, CASE WHEN draw = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN draw = 1 THEN '' WHEN draw = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE WHEN draw = 3 THEN 2 ELSE 1 END)) AS copy
  FROM base WHERE draw <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, left(role, 1) AS initial,
    regexp_matches(text, '^[ 	-]*$') AS is_blank
  FROM hurt),
faulty AS (
  SELECT *, NOT is_blank AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS is_duplicate,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before
  FROM placed),
rows_ AS (
  SELECT *, is_blank OR is_duplicate AS gone,
    NOT is_blank AND NOT is_duplicate AND NOT regexp_matches(text, '[.!?][ 	-]*$') AS is_truncated
  FROM faulty),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (is_blank) AS blank, count(*) FILTER (is_duplicate) AS duplicate,
    count(*) FILTER (is_truncated) AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM rows_ GROUP BY conv_id),
step AS (
  SELECT conv_id, n, 0::BIGINT AS i, {{'c': 0, 'e': ''}} AS o, NULL::STRUCT(c INT, e VARCHAR) AS s,
    NULL::STRUCT(c INT, e VARCHAR) AS u, NULL::STRUCT(c INT, e VARCHAR) AS a
  FROM counts
  UNION ALL
  SELECT conv_id, n, i, {_edits_sql()} FROM (
    SELECT q.*, r.initial, r.gone, r.is_truncated FROM
      ({_inserted_sql("conv_id, n, i + 1 AS i, o, s, u, a", "step WHERE i < n")}) q
    JOIN rows_ r ON r.conv_id IS NOT DISTINCT FROM q.conv_id AND r.i = q.i)),
best AS (
  SELECT conv_id, {_least_sql("o", "ia")} AS v
  FROM ({_inserted_sql("conv_id, o, s, u, a", "step WHERE i = n")})),
edits AS (
  SELECT conv_id, v.c AS cost, v.e AS audit, unnest(range(1, length(v.e) + 1)) AS p FROM best),
kept AS (
  SELECT conv_id, p, substr(audit, p, 1) AS edit, length(replace(left(audit, p), 'I', '')) AS i FROM edits),
written AS (
  SELECT k.conv_id, p, edit, CASE WHEN edit = 'I' THEN '' ELSE text END AS text, role, initial,
    row_number() OVER (PARTITION BY k.conv_id ORDER BY p)
      - max(CASE WHEN edit = 'K' AND initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY k.conv_id) AS place
  FROM kept k JOIN rows_ r ON r.conv_id IS NOT DISTINCT FROM k.conv_id AND r.i = greatest(k.i, 1) WHERE edit <> 'D'),
texts AS (
  SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN place % 2 = 1 THEN 'user' ELSE 'assistant' END
    || ':' || text, chr(10) ORDER BY p) AS whole
  FROM written GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(v.c, 0)::BIGINT AS cost,
  coalesce(v.e, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM o.conv_id"""


@CATALOG.add("op12_repair_conversations", REPAIR_SQL)
def op12_repair_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.reports(conversation_repair.damaged(table(spark, sf_dir, "conversations")))


# 13: hard negatives

NEGATIVES_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q, row_number() OVER () AS row
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.row, a.vec_id AS anchor_id, b.row AS other, b.vec_id AS other_id, a.label = b.label AS same,
    list_sum(list_transform(list_zip(a.q, b.q), lambda z: coalesce(z[1] * z[2], 0)))::BIGINT AS score
  FROM v a JOIN v b ON a.row <> b.row WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT * FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY row ORDER BY score DESC, other_id, other) <= 5)
SELECT p.anchor_id, p.other_id AS positive_id,
  (row_number() OVER (PARTITION BY p.row, p.other ORDER BY n.score DESC, n.other_id, n.other))::INTEGER AS rank,
  n.other_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON p.row = n.row
WHERE NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
QUALIFY rank <= 10"""


@CATALOG.add("op13_hard_negatives", NEGATIVES_SQL)
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"))
