"""Rows for training: padded, chunked, masked."""

from pyspark.sql import functions as F

from catalog.registry import Catalog
from catalog.text_queries import documents, encoded_documents
from catalog.views import (
    FEATURES_SQL,
    ROUTES,
    draw_sql,
    events,
    events_sql,
    features,
    hash_sql,
    routed,
    words_sql,
)
from strandline.functions.hashing import hash32
from strandline.functions.text import spaced_words
from strandline.operators.encoding import (
    chunk_from_end,
    chunk_parts_from_end,
    copy_labels,
    decode,
    encode,
    pad_sequence,
    split_tail,
)
from strandline.operators.masking import mask_multi, mask_tokens, mask_words
from strandline.operators.sequences import customer_sequences, labelled_windows, to_text
from strandline.operators.vocabulary import word_vocabulary
from strandline.plans.feature_rows import feature_rows
from strandline.plans.training_rows import event_vocabulary, fill_in_rows, period_datasets, training_rows

CATALOG = Catalog()


def _texts(df, *arrays):
    """Arrays as texts, so that both engines show the same."""
    return df.withColumns({a: F.array_join(a, ",") for a in arrays})


def _padded_sql(body):
    """[CLS] body [SEP] and padding to 256, as text, with the mask and the types."""
    return f"""'2,' || concat(array_to_string({body}, ','), CASE WHEN len({body}) > 0 THEN ',' ELSE '' END) || '3'
           || repeat(',1', 254 - len({body})) AS input_ids,
         substr(repeat(',1', len({body}) + 2) || repeat(',0', 254 - len({body})), 2) AS attention_mask,
         '0' || repeat(',0', 255) AS token_type_ids"""


_ROW = ("input_ids", "attention_mask", "token_type_ids")


def _pad(name, keep, cut):
    @CATALOG.add(name, words_sql(f"SELECT doc_id, {_padded_sql('b')} FROM (SELECT doc_id, {cut} AS b FROM ids)"))
    def run(spark, sf):
        return _texts(pad_sequence(encoded_documents(spark, sf), keep=keep), *_ROW)


_pad("v7_pad_tail", "tail", "list_slice(ids, greatest(len(ids) - 253, 1), len(ids))")
_pad("v7_pad_head", "head", "list_slice(ids, 1, 254)")

_CHUNKS_SQL = """SELECT doc_id, (len(ids) - i) // 254 AS chunk, list(ids[i] ORDER BY i) AS b
                 FROM (SELECT doc_id, ids, unnest(range(1, len(ids) + 1)) AS i FROM ids) GROUP BY ALL"""


@CATALOG.add(
    "v8_chunk_from_end",
    words_sql(f"SELECT doc_id, CAST(chunk AS int) AS chunk, array_to_string(b, ',') AS input_ids FROM ({_CHUNKS_SQL})"),
)
def chunks(spark, sf):
    return _texts(chunk_from_end(encoded_documents(spark, sf)), "input_ids")


# Customers as words, and their vocabulary; every event text is one word.
_CUSTOMER_SQL = """
, cust AS (SELECT column1, list(evnt ORDER BY column2, column3, event_id) FILTER (evnt IS NOT NULL) AS ws
           FROM routed GROUP BY column1),
ev AS (SELECT piece, 4 + row_number() OVER (ORDER BY n DESC, piece) AS id
       FROM (SELECT unnest(ws) AS piece, count(*) AS n FROM cust GROUP BY 1)),
word AS (SELECT column1, i, id FROM (SELECT column1, unnest(ws) AS piece, generate_subscripts(ws, 1) AS i FROM cust)
         JOIN ev USING (piece)),
cids AS (SELECT column1, list(id ORDER BY i) AS ids FROM word GROUP BY column1)
"""


def _customers(spark, sf, **options):
    texts = to_text(customer_sequences(routed(spark, sf), **options))
    return texts, word_vocabulary(texts, min_frequency=1)


@CATALOG.add(
    "v8_chunk_parts_from_end",
    events_sql(_CUSTOMER_SQL + """
    SELECT column1, CAST(chunk AS int) AS chunk, string_agg(id, ',' ORDER BY i) AS input_ids
    FROM (SELECT column1, i, id, (max(i) OVER (PARTITION BY column1) - i) // 10 AS chunk FROM word)
    GROUP BY column1, chunk"""),
)
def part_chunks(spark, sf):
    texts, vocab = _customers(spark, sf, part_size=25)
    return _texts(chunk_parts_from_end(encode(texts, vocab), "column1", size=10), "input_ids")


@CATALOG.add(
    "v9_copy_labels",
    words_sql(f"""SELECT doc_id, CAST(chunk AS int) AS chunk, input_ids, input_ids AS labels
                  FROM (SELECT doc_id, chunk, {_padded_sql('b')} FROM ({_CHUNKS_SQL}))"""),
)
def copied(spark, sf):
    rows = copy_labels(pad_sequence(chunk_from_end(encoded_documents(spark, sf))))
    return _texts(rows, "input_ids", "labels").select("doc_id", "chunk", "input_ids", "labels")


def _hashes_sql(round_):
    return f"list_transform(range(len(ids)), lambda i: {hash_sql('42', 'doc_id', str(round_), 'i')})"


_CUT = int(0.15 * 2**32)


@CATALOG.add(
    "k1_mask_multi",
    words_sql(f"""
    , t AS (SELECT doc_id, list_slice(ids, 1, 254) AS ids FROM ids WHERE len(ids) > 48),
    h AS (SELECT *, {_hashes_sql(0)} AS h0, {_hashes_sql(1)} AS h1, {_hashes_sql(2)} AS h2 FROM t),
    n AS (SELECT *, len(list_filter(h0, lambda x: x < {_CUT})) AS n0, len(list_filter(h1, lambda x: x < {_CUT})) AS n1,
                 len(list_filter(h2, lambda x: x < {_CUT})) AS n2 FROM h),
    c AS (SELECT doc_id, ids, CASE WHEN n0 >= 2 THEN h0 WHEN n1 >= 2 THEN h1 WHEN n2 >= 2 THEN h2 ELSE h0 END AS hs,
                 CASE WHEN greatest(n0, n1, n2) >= 2 THEN {_CUT} ELSE list_sort(h0)[2] + 1 END AS cut FROM n),
    m AS (SELECT doc_id, list_transform(ids, lambda t, i: CASE WHEN hs[i] < cut THEN 4 ELSE t END) AS b,
                 list_transform(ids, lambda t, i: CASE WHEN hs[i] < cut THEN t ELSE -100 END) AS l FROM c)
    SELECT doc_id, {_padded_sql('b')}, '-100,' || array_to_string(l, ',') || repeat(',-100', 255 - len(l)) AS labels FROM m"""),
)
def multi(spark, sf):
    return _texts(mask_multi(encoded_documents(spark, sf), "doc_id"), *_ROW, "labels")


def replaced_sql(chosen, key, size):
    """The 80/10/10 rule over the chosen ids of a list called ids."""
    branch, random_id = draw_sql("42", "'branch'", key, "i - 1"), draw_sql("42", "'id'", key, "i - 1")
    return f"""list_transform(ids, lambda t, i: CASE WHEN t >= 5 AND {chosen} THEN
                 CASE WHEN {branch} < 0.8 THEN 4 WHEN {branch} < 0.9 THEN CAST(floor({random_id} * {size}) AS int) ELSE t END
                 ELSE t END) AS input_ids,
               list_transform(ids, lambda t, i: CASE WHEN t >= 5 AND {chosen} THEN t ELSE -100 END) AS labels"""


VOCAB_SIZE = 2000
MASKED_SQL = f"""
, masked AS (SELECT doc_id, {replaced_sql(draw_sql('42', "'token'", 'doc_id', 'i - 1') + ' < 0.1', 'doc_id', VOCAB_SIZE)} FROM ids)
"""


def masked_documents(spark, sf):
    return mask_tokens(encoded_documents(spark, sf), "doc_id", VOCAB_SIZE)


@CATALOG.add(
    "k2_mask_tokens",
    words_sql(MASKED_SQL + """SELECT doc_id, array_to_string(input_ids, ',') AS input_ids,
                                array_to_string(labels, ',') AS labels FROM masked"""),
)
def token_masks(spark, sf):
    return _texts(masked_documents(spark, sf), "input_ids", "labels")


@CATALOG.add(
    "k3_mask_words",
    words_sql(f"""
    , cut AS (SELECT doc_id, flatten(list_transform(ws, lambda w:
                CASE WHEN length(w) > 4 THEN [substr(w, 1, 4), '##' || substr(w, 5)] ELSE [w] END)) AS ps FROM docs),
    p AS (SELECT doc_id, (len(ps) - i) // 254 AS chunk, list(ps[i] ORDER BY i) AS ps
          FROM (SELECT doc_id, ps, unnest(range(1, len(ps) + 1)) AS i FROM cut) GROUP BY ALL),
    starts AS (SELECT doc_id || '/' || chunk AS row_key, list_transform(ps, lambda x: {hash_sql('x')} % 1000) AS ids,
                      list_transform(ps, lambda x: CASE WHEN starts_with(x, '##') THEN 0 ELSE 1 END) AS ss FROM p),
    q AS (SELECT *, list_transform(ss, lambda s, i: list_sum(list_slice(ss, 1, i))) AS word FROM starts),
    m AS (SELECT row_key, {replaced_sql(draw_sql('42', "'word'", 'row_key', 'CAST(word[i] AS int)') + ' < 0.15', 'row_key', 1000)} FROM q)
    SELECT row_key, array_to_string(input_ids, ',') AS input_ids, array_to_string(labels, ',') AS labels FROM m"""),
)
def word_masks(spark, sf):
    halves = F.transform(
        spaced_words(F.col("text")),
        lambda w: F.when(
            F.length(w) > 4, F.array(F.substring(w, 1, 4), F.concat(F.lit("##"), F.substr(w, F.lit(5))))
        ).otherwise(F.array(w)),
    )
    pieces = documents(spark, sf).select("doc_id", F.flatten(halves).alias("pieces"))
    rows = chunk_from_end(pieces, "pieces").select(
        F.concat_ws("/", "doc_id", "chunk").alias("row_key"),
        "pieces",
        F.transform("pieces", lambda x: (hash32(x) % 1000).cast("int")).alias("input_ids"),
    )
    return _texts(mask_words(rows, "row_key", 1000), "input_ids", "labels").drop("pieces")


@CATALOG.add(
    "k4_split_tail",
    events_sql(_CUSTOMER_SQL + """
    SELECT column1, array_to_string(list_slice(ws, 1, len(ws) - 5), ' ') AS history,
           array_to_string(list_slice(ws, len(ws) - 4, len(ws)), ' ') AS targets
    FROM cust WHERE len(ws) > 5"""),
)
def held_out(spark, sf):
    return _held_out(spark, sf)


@CATALOG.add("k4_split_tail_in_parts", CATALOG.sql["k4_split_tail"])
def held_out_in_parts(spark, sf):
    return _held_out(spark, sf, part_size=10)


def _held_out(spark, sf, **options):
    """Histories of several parts are put together, for the comparison only."""
    texts, _ = _customers(spark, sf, **options)
    rows = split_tail(texts, "column1").withColumn("targets", F.array_join("targets", " "))
    parts = F.sort_array(F.collect_list(F.struct("part", "history")))
    rows = rows.groupBy("column1", "targets").agg(parts.alias("parts"))
    return rows.select("column1", F.array_join("parts.history", " ").alias("history"), "targets")


def _fill(name, width, **options):
    room = width - 7

    @CATALOG.add(
        name,
        events_sql(_CUSTOMER_SQL + f"""
        , f AS (SELECT column1, list_slice(ids, greatest(len(ids) - 5 - {room} + 1, 1), len(ids) - 5) AS past,
                       list_slice(ids, len(ids) - 4, len(ids)) AS goal FROM cids WHERE len(ids) > 5)
        SELECT column1, '2,' || array_to_string(past, ',') || ',4,4,4,4,4,3' || repeat(',1', {room} - len(past)) AS input_ids,
               '-100' || repeat(',-100', len(past)) || ',' || array_to_string(goal, ',') || ',3'
                 || repeat(',-100', {room} - len(past)) AS labels FROM f"""),
    )
    def run(spark, sf):
        texts, vocab = _customers(spark, sf, **options)
        rows = fill_in_rows(texts, vocab, max_len=width)
        return _texts(rows, "input_ids", "labels").select("column1", "input_ids", "labels")


_fill("k5_fill_rows", 256)
_fill("k5_fill_rows_narrow", 32)
_fill("k5_fill_rows_in_parts", 32, part_size=10)


@CATALOG.add(
    "training_rows_multi",
    events_sql(_CUSTOMER_SQL + f"""
    , w AS (SELECT column1, i, id, (max(i) OVER (PARTITION BY column1) - i) // 254 AS chunk FROM word),
    r AS (SELECT column1, chunk, column1 || '/' || chunk AS doc_id, list(id ORDER BY i) AS ids
          FROM w GROUP BY column1, chunk HAVING count(*) > 48),
    h AS (SELECT *, {_hashes_sql(0)} AS h0, {_hashes_sql(1)} AS h1, {_hashes_sql(2)} AS h2 FROM r),
    n AS (SELECT *, len(list_filter(h0, lambda x: x < {_CUT})) AS n0, len(list_filter(h1, lambda x: x < {_CUT})) AS n1,
                 len(list_filter(h2, lambda x: x < {_CUT})) AS n2 FROM h),
    c AS (SELECT column1, chunk, ids, CASE WHEN n0 >= 2 THEN h0 WHEN n1 >= 2 THEN h1 WHEN n2 >= 2 THEN h2 ELSE h0 END AS hs,
                 CASE WHEN greatest(n0, n1, n2) >= 2 THEN {_CUT} ELSE list_sort(h0)[2] + 1 END AS cut FROM n),
    m AS (SELECT column1, chunk, list_transform(ids, lambda t, i: CASE WHEN hs[i] < cut THEN 4 ELSE t END) AS b,
                 list_transform(ids, lambda t, i: CASE WHEN hs[i] < cut THEN t ELSE -100 END) AS l FROM c)
    SELECT column1, CAST(chunk AS int) AS chunk,
           CASE WHEN {draw_sql('42', "'test'", 'column1')} < 0.2 THEN 'test'
                WHEN {draw_sql('42', "'valid'", 'column1')} < 0.1 THEN 'valid' ELSE 'train' END AS split,
           {_padded_sql('b')}, '-100,' || array_to_string(l, ',') || repeat(',-100', 255 - len(l)) AS labels FROM m"""),
)
def multi_rows(spark, sf):
    texts, vocab = _customers(spark, sf)
    rows = training_rows(routed(spark, sf), vocab, VOCAB_SIZE, masking="multi", subword=False)
    return _texts(rows, *_ROW, "labels")


@CATALOG.add("training_rows_subword")
def subword_rows(spark, sf):
    vocab = event_vocabulary(events(spark, sf), ROUTES, min_frequency=2)
    rows = training_rows(routed(spark, sf), vocab, VOCAB_SIZE, masking="words")
    return _texts(rows, *_ROW, "labels")


@CATALOG.add(
    "period_datasets",
    events_sql("""SELECT 'week' AS kind, column1, 0::bigint AS part, month(column2)::int AS month, weekofyear(column2)::int AS number,
                    coalesce(string_agg(evnt, ' ' ORDER BY column2, column3, event_id), '') AS evnt
                  FROM routed GROUP BY ALL
                  UNION ALL
                  SELECT 'month', column1, 0::bigint, month(column2)::int AS month, 0::int,
                    coalesce(string_agg(evnt, ' ' ORDER BY column2, column3, event_id), '')
                  FROM routed GROUP BY ALL"""),
)
def periods(spark, sf):
    week, month = period_datasets(events(spark, sf), ROUTES)
    week = week.select(F.lit("week").alias("kind"), "column1", "part", "month", F.col("evnt_w").alias("number"), "evnt")
    month = month.select(
        F.lit("month").alias("kind"), "column1", "part", F.month("date").alias("month"), F.lit(0).alias("number"), "evnt"
    )
    return week.unionByName(month)


@CATALOG.add(
    "feature_rows",
    events_sql(_CUSTOMER_SQL + f""", {FEATURES_SQL},
    picked AS (SELECT column1, column2, x, CAST(mask <> 0 AS int) AS label, column1 || '/' || column2 AS row_key,
                      CAST(coalesce(cust_bin1 + 1, 0) AS int) AS cust_id1, CAST(coalesce(cust_bin2 + 1, 0) AS int) AS cust_id2,
                      CAST(coalesce(cust_bin10 + 1, 0) AS int) AS cust_id10
               FROM frames LEFT JOIN feats USING (column1)),
    sampled AS (SELECT * FROM picked WHERE {draw_sql('42', 'row_key')} < CASE label WHEN 0 THEN 0.25 ELSE 0.5 END),
    toks AS (SELECT row_key, unnest(ws) AS piece, generate_subscripts(ws, 1) AS i
             FROM (SELECT row_key, list_filter(string_split(x, ' '), lambda w: w <> '') AS ws FROM sampled)),
    bodies AS (SELECT row_key, list(id ORDER BY i) AS ids FROM toks JOIN ev USING (piece) GROUP BY row_key),
    b AS (SELECT s.*, coalesce(list_slice(ids, greatest(len(ids) - 253, 1), len(ids)), []) AS b
          FROM sampled s LEFT JOIN bodies USING (row_key))
    SELECT row_key, column1, cust_id1, cust_id2, cust_id10, CAST(label AS float) AS label,
           CASE WHEN {draw_sql('42', "'test'", 'column1')} < 0.2 THEN 'test'
                WHEN {draw_sql('42', "'valid'", 'column1')} < 0.1 THEN 'valid' ELSE 'train' END AS split,
           {_padded_sql('b')} FROM b"""),
)
def with_features(spark, sf):
    return _with_features(spark, sf)


@CATALOG.add("feature_rows_in_parts", CATALOG.sql["feature_rows"])
def with_features_in_parts(spark, sf):
    return _with_features(spark, sf, part_size=10)


def _with_features(spark, sf, **options):
    _, vocab = _customers(spark, sf)
    windows = labelled_windows(routed(spark, sf), only_positive=False, **options)
    rows = windows.join(features(spark, sf), "column1", "left").select(
        "column1",
        "column2",
        "part",
        F.concat_ws("/", "column1", F.col("column2").cast("string")).alias("row_key"),
        F.col("x").alias("evnt"),
        F.exists("y", lambda flag: flag > 0).cast("int").alias("label"),
        "cust_bin1",
        "cust_bin2",
        "cust_bin10",
    )
    names = {f"cust_bin{i}": f"cust_id{i}" for i in range(1, 11)}
    encoded = feature_rows(rows, vocab, names, fractions={0: 0.25, 1: 0.5}, row_key="row_key")
    return _texts(encoded.withColumn("label", F.col("labels")[0]), *_ROW).drop("labels", "column2")


@CATALOG.add(
    "training_rows_subword_text",
    events_sql("""SELECT column1, coalesce(string_agg(
                    nullif(replace(regexp_replace(replace(evnt, ' ', ''), '[^가-힣0-9a-zA-Z]', '_', 'g'), '_', ''), ''), ' '
                    ORDER BY column2, column3, event_id), '') AS evnt
                  FROM routed WHERE evnt IS NOT NULL GROUP BY column1"""),
)
def subword_texts(spark, sf):
    """Training rows with their labels put back, decoded and joined: the customers' texts again."""
    vocab = event_vocabulary(events(spark, sf), ROUTES, min_frequency=2)
    rows = training_rows(routed(spark, sf), vocab, VOCAB_SIZE, masking="words")
    pairs = F.zip_with("input_ids", "labels", lambda t, label: F.when(label == -100, t).otherwise(label))
    ids = rows.select("column1", "chunk", F.filter(pairs, lambda t: t >= 5).alias("ids"))
    parts = F.sort_array(F.collect_list(F.struct((-F.col("chunk")).alias("order"), "ids")))
    whole = ids.groupBy("column1").agg(parts.alias("parts")).select("column1", F.flatten("parts.ids").alias("ids"))
    text = F.replace(F.array_join("pieces", " "), F.lit(" ##"), F.lit(""))
    return decode(whole, vocab, "ids").select("column1", text.alias("evnt"))
