"""Cleaning, vocabularies, encoding."""

from pyspark.sql import functions as F

from catalog.registry import Catalog
from catalog.views import ROUTES, events, events_sql, routed, words_sql
from strandline.functions.text import clean_event, last_words, spaced_words, strip_underscores, vocabulary_text
from strandline.operators.encoding import decode, encode, encode_by_join
from strandline.operators.ordering import with_position
from strandline.operators.sequences import customer_sequences, to_text
from strandline.operators.vocabulary import train_wordpiece, word_counts, word_vocabulary
from strandline.plans.training_rows import event_vocabulary, vocabulary_events
from strandline.sources.tables import load, spread

CATALOG = Catalog()


def documents(spark, sf):
    return spread(load(spark, sf, "documents").select("doc_id", "text"))


def encoded_documents(spark, sf):
    """Documents as ids of the words that occur at least 20 times."""
    docs = documents(spark, sf)
    return encode(docs, word_vocabulary(docs, "text"), "text").select("doc_id", "input_ids")


@CATALOG.add(
    "v1_clean_events",
    "SELECT doc_id, regexp_replace(replace(text, ' ', ''), '[^가-힣0-9a-zA-Z]', '_', 'g') AS text FROM documents",
)
def cleaned(spark, sf):
    return documents(spark, sf).withColumn("text", clean_event(F.col("text")))


@CATALOG.add("v2_strip_underscores", events_sql("SELECT event_id, replace(evnt, '_', '') AS evnt FROM routed"))
def stripped(spark, sf):
    return routed(spark, sf).select("event_id", strip_underscores(F.col("evnt")).alias("evnt"))


@CATALOG.add(
    "vocabulary_events",
    events_sql("""SELECT replace(evnt, '_', '') AS evnt FROM (
                    SELECT DISTINCT regexp_replace(replace(evnt, ' ', ''), '[^가-힣0-9a-zA-Z]', '_', 'g') AS evnt
                    FROM routed WHERE evnt IS NOT NULL)"""),
)
def corpus(spark, sf):
    return vocabulary_events(events(spark, sf), ROUTES)


@CATALOG.add(
    "v3_word_vocabulary",
    words_sql("""SELECT piece, id, freq FROM vocab UNION ALL
                 SELECT unnest(['[UNK]', '[PAD]', '[CLS]', '[SEP]', '[MASK]']), unnest([0, 1, 2, 3, 4]), NULL"""),
)
def words(spark, sf):
    return word_vocabulary(documents(spark, sf), "text")


@CATALOG.add("v4_subword_vocabulary")
def subwords(spark, sf):
    """30,000 merges at most, of pairs that occur 20 times."""
    return train_wordpiece(documents(spark, sf), "text", vocab_size=30_000)


# Words as pieces between two control characters; one merge of the most frequent pair in each step.
_MERGES_SQL = r"""
, spelled AS (
    SELECT chr(1) || left(w, 1) || regexp_replace(substr(w, 2), '(?s)(.)', chr(2) || chr(1) || '##\1', 'g') || chr(2) AS s, freq
    FROM (SELECT nfc_normalize(piece) AS w, sum(freq)::bigint AS freq FROM counts GROUP BY 1)),
merged AS (
  WITH RECURSIVE step AS (
    SELECT 0 AS i, s, freq, '' AS piece, 0::bigint AS n FROM spelled
    UNION ALL
    SELECT i + 1, replace(s, chr(1) || l || chr(2) || chr(1) || r || chr(2), chr(1) || l || substr(r, 3) || chr(2)), freq,
           l || substr(r, 3), best.n
    FROM step, (SELECT l, r, sum(freq)::bigint AS n FROM (
                  SELECT freq, ps[j] AS l, ps[j + 1] AS r FROM (
                    SELECT freq, ps, unnest(range(1, len(ps))) AS j FROM (
                      SELECT freq, string_split(substr(s, 2, length(s) - 2), chr(2) || chr(1)) AS ps FROM step)))
                GROUP BY l, r HAVING sum(freq) >= 1000 ORDER BY n DESC, l, r LIMIT 1) best)
  SELECT piece, max(n) AS freq FROM step WHERE i > 0 GROUP BY piece),
pieces AS (
  SELECT piece, max(freq) AS freq FROM (
    SELECT p AS piece, sum(freq)::bigint AS freq
    FROM (SELECT freq, unnest(string_split(substr(s, 2, length(s) - 2), chr(2) || chr(1))) AS p FROM spelled) GROUP BY p
    UNION ALL SELECT DISTINCT regexp_replace(p, '^##(.)$', '\1', 's'), 0
    FROM (SELECT unnest(string_split(substr(s, 2, length(s) - 2), chr(2) || chr(1))) AS p FROM spelled)
    UNION ALL SELECT piece, freq FROM merged) GROUP BY piece)
SELECT piece, CAST(4 + row_number() OVER (ORDER BY freq DESC, piece) AS int) AS id, freq FROM pieces
UNION ALL SELECT unnest(['[UNK]', '[PAD]', '[CLS]', '[SEP]', '[MASK]']), unnest([0, 1, 2, 3, 4]), NULL"""


@CATALOG.add("v4_frequent_merges", words_sql(_MERGES_SQL))
def frequent_merges(spark, sf):
    """All merges of pairs that occur 1,000 times, in rounds over shards of words."""
    return train_wordpiece(documents(spark, sf), "text", min_frequency=1_000, small=0)


@CATALOG.add("v4_frequent_merges_in_one_task", words_sql(_MERGES_SQL))
def frequent_merges_in_one_task(spark, sf):
    return train_wordpiece(documents(spark, sf), "text", min_frequency=1_000)


_IDS_SQL = words_sql("SELECT doc_id, array_to_string(ids, ' ') AS ids FROM ids")


@CATALOG.add("v5_encode_words", _IDS_SQL)
def word_ids(spark, sf):
    return encoded_documents(spark, sf).select("doc_id", F.array_join("input_ids", " ").alias("ids"))


@CATALOG.add("v5_encode_words_by_join", _IDS_SQL)
def word_ids_by_join(spark, sf):
    docs = documents(spark, sf)
    ids = encode_by_join(docs, word_vocabulary(docs, "text"), "doc_id", "text")
    return ids.select("doc_id", F.array_join("input_ids", " ").alias("ids"))


# Short beginnings and inner stretches of the words, where they occur at least 20 times.
_SHORT_PIECES_SQL = """
, firsts AS (SELECT substr(w, 1, k) AS piece FROM (SELECT unnest(ws) AS w FROM docs), range(1, 4) r(k) WHERE length(w) >= k),
inner_ AS (SELECT '##' || substr(w, p, k) AS piece
           FROM (SELECT w, unnest(range(2, length(w) + 1)) AS p FROM (SELECT unnest(ws) AS w FROM docs)), range(1, 4) r(k)
           WHERE p + k - 1 <= length(w)),
sv AS (SELECT piece, CAST(4 + row_number() OVER (ORDER BY piece) AS int) AS id
       FROM (SELECT piece FROM firsts UNION ALL SELECT piece FROM inner_) GROUP BY piece HAVING count(*) >= 20)
"""


@CATALOG.add(
    "v5_encode_short_pieces",
    words_sql(_SHORT_PIECES_SQL + """,
    enc AS (
      WITH RECURSIVE step(w, pos, ids) AS (
        SELECT w, 1, CAST([] AS int[]) FROM (SELECT DISTINCT unnest(ws) AS w FROM docs)
        UNION ALL
        SELECT w, CASE WHEN a.id IS NOT NULL THEN pos + 3 WHEN b.id IS NOT NULL THEN pos + 2
                       WHEN c.id IS NOT NULL THEN pos + 1 ELSE 100000 END,
               CASE WHEN coalesce(a.id, b.id, c.id) IS NULL THEN CAST([0] AS int[])
                    ELSE list_append(ids, coalesce(a.id, b.id, c.id)) END
        FROM step
        LEFT JOIN sv a ON a.piece = CASE WHEN pos > 1 THEN '##' ELSE '' END || substr(w, pos, 3) AND pos + 2 <= length(w)
        LEFT JOIN sv b ON b.piece = CASE WHEN pos > 1 THEN '##' ELSE '' END || substr(w, pos, 2) AND pos + 1 <= length(w)
        LEFT JOIN sv c ON c.piece = CASE WHEN pos > 1 THEN '##' ELSE '' END || substr(w, pos, 1)
        WHERE pos <= length(w))
      SELECT w, ids FROM step WHERE pos > length(w)),
    spread AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM docs)
    SELECT doc_id, array_to_string(flatten(list(enc.ids ORDER BY i)), ' ') AS ids
    FROM spread JOIN enc USING (w) GROUP BY doc_id"""),
)
def short_pieces(spark, sf):
    docs = documents(spark, sf)
    word = docs.select(F.explode(spaced_words(F.col("text"))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    sizes, places = F.array(F.lit(1), F.lit(2), F.lit(3)), F.sequence(F.lit(2), F.greatest(F.length("w"), F.lit(2)))
    firsts = word.select("w", "n", F.explode(sizes).alias("k"), F.lit(1).alias("p"))
    inner = word.select("w", "n", F.explode(places).alias("p")).select("w", "n", F.explode(sizes).alias("k"), "p")
    pieces = (
        firsts.unionByName(inner)
        .filter("p + k - 1 <= length(w)")
        .selectExpr("if(p > 1, '##', '') || substr(w, p, k) AS piece", "n")
        .groupBy("piece")
        .agg(F.sum("n").alias("n"))
        .filter("n >= 20")
    )
    vocab = with_position(pieces, "piece").select("piece", (F.col("position") + 5).cast("int").alias("id"))
    ids = encode(docs, vocab, "text", subword=True)
    return ids.select("doc_id", F.array_join("input_ids", " ").alias("ids"))


@CATALOG.add(
    "v5_encode_subwords",
    events_sql("""SELECT column1, 0::bigint AS part, coalesce(string_agg(
                    nullif(replace(regexp_replace(replace(evnt, ' ', ''), '[^가-힣0-9a-zA-Z]', '_', 'g'), '_', ''), ''), ' '
                    ORDER BY column2, column3, event_id), '') AS evnt
                  FROM routed GROUP BY column1"""),
)
def subword_ids(spark, sf):
    """Encoded and decoded again: the texts, as no piece of theirs is unknown."""
    vocab = event_vocabulary(events(spark, sf), ROUTES, min_frequency=2)
    cleaned_events = routed(spark, sf).withColumn("evnt", vocabulary_text(F.col("evnt")))
    ids = encode(to_text(customer_sequences(cleaned_events)), vocab, subword=True)
    return decode(ids, vocab).select("column1", "part", _joined("pieces").alias("evnt"))


def _joined(pieces):
    """Pieces back to words."""
    return F.replace(F.array_join(pieces, " "), F.lit(" ##"), F.lit(""))


@CATALOG.add("v5_encode_decomposed", words_sql("SELECT doc_id, array_to_string(ids, ' ') AS ids FROM ids"))
def decomposed(spark, sf):
    """Texts in decomposed form have the ids of the composed ones, as far as these occur in the documents."""
    return _decomposed(spark, sf, lambda docs, vocab: encode(docs, vocab, "text"))


@CATALOG.add("v5_encode_decomposed_by_join", words_sql("SELECT doc_id, array_to_string(ids, ' ') AS ids FROM ids"))
def decomposed_by_join(spark, sf):
    return _decomposed(spark, sf, lambda docs, vocab: encode_by_join(docs, vocab, "doc_id", "text"))


def _decomposed(spark, sf, how):
    docs = documents(spark, sf)
    vocab = word_vocabulary(docs, "text")
    text = F.replace(F.replace("text", F.lit("é"), F.lit("e\u0301")), F.lit("ü"), F.lit("u\u0308"))
    return how(docs.withColumn("text", text), vocab).select("doc_id", F.array_join("input_ids", " ").alias("ids"))


@CATALOG.add("v3_decomposed_vocabulary", CATALOG.sql["v3_word_vocabulary"])
def decomposed_words(spark, sf):
    """Half of the documents in decomposed form give the vocabulary of the composed ones."""
    text = F.replace(F.replace("text", F.lit("é"), F.lit("e\u0301")), F.lit("ü"), F.lit("u\u0308"))
    docs = documents(spark, sf).withColumn("text", F.when(F.col("doc_id") % 2 == 0, text).otherwise(F.col("text")))
    return word_vocabulary(docs, "text")


@CATALOG.add(
    "v4_alphabet",
    words_sql(r"""SELECT c AS piece, sum(freq)::bigint AS freq FROM (
                    SELECT CASE WHEN i > 1 THEN '##' ELSE '' END || substr(w, i, 1) AS c, freq
                    FROM (SELECT nfc_normalize(piece) AS w, freq, unnest(range(1, length(nfc_normalize(piece)) + 1)) AS i FROM counts))
                  GROUP BY c"""),
)
def alphabet(spark, sf):
    """Of a trained vocabulary the pieces of one character that occur as such."""
    vocab = train_wordpiece(documents(spark, sf), "text", vocab_size=400)
    one = F.length(F.regexp_replace("piece", "^##(?=.)", "")) == 1
    return vocab.filter(one & (F.col("freq") > 0)).select("piece", "freq")


@CATALOG.add("v4_roundtrip", words_sql("SELECT DISTINCT nfc_normalize(piece) AS word, nfc_normalize(piece) AS joined FROM counts"))
def roundtrip(spark, sf):
    """Every word is the sum of its pieces in a trained vocabulary."""
    docs = documents(spark, sf)
    vocab = train_wordpiece(docs, "text", vocab_size=400)
    words_ = word_counts(docs, "text").select("word")
    return decode(encode(words_, vocab, "word", subword=True), vocab).select("word", _joined("pieces").alias("joined"))


@CATALOG.add(
    "v6_last_words",
    r"""SELECT doc_id, array_to_string(list_slice(ws, greatest(len(ws) - 255, 1), len(ws)), ' ') AS text
        FROM (SELECT doc_id, list_filter(string_split(text, ' '), lambda w: w <> '') AS ws FROM documents)""",
)
def tails(spark, sf):
    return documents(spark, sf).withColumn("text", last_words(F.col("text")))
