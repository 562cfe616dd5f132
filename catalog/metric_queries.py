"""Metrics of scored tables, scoring, baselines."""

import numpy as np
from pyspark.sql import functions as F

from catalog.registry import Catalog
from catalog.row_queries import MASKED_SQL, VOCAB_SIZE, masked_documents
from catalog.text_queries import encoded_documents
from catalog.views import (
    ROUTES,
    RULES,
    draw_sql,
    flags_sql,
    events,
    events_sql,
    hash_sql,
    routed,
    scored,
    scored_sql,
    words_sql,
)
from strandline.functions.hashing import HASH_RANGE, draw, hash32
from strandline.operators.encoding import join_parts, pad_sequence, split_tail
from strandline.operators.evaluate import (
    auprc,
    auroc,
    bce_from_logits,
    binary_accuracy,
    binary_prf,
    confusion,
    decide,
    masked_ce,
    mse,
    multilabel_f1,
    slot_accuracy,
    slot_prefix_accuracy,
    token_accuracy,
)
from strandline.operators.sampling import split
from strandline.operators.scoring import fill_next, fit_labels, next_event_model, predict_labels, score
from strandline.operators.sequences import customer_sequences, to_text
from strandline.plans.evaluation import evaluation_report
from strandline.plans.windows_job import window_dataset

CATALOG = Catalog()


def _rounded(df, *names):
    return df.withColumns({c: F.round(c, 6) for c in names})


@CATALOG.add("e1_decide", scored_sql("SELECT doc_id, round(1 / (1 + exp(-logit)), 6) AS prob, pred FROM s"))
def decisions(spark, sf):
    return _rounded(decide(scored(spark, sf).drop("prob")).select("doc_id", "prob", "pred"), "prob")


@CATALOG.add("e2_accuracy", scored_sql("SELECT round(avg(CAST(label = pred AS int)), 6) AS accuracy FROM s"))
def accuracy(spark, sf):
    return _rounded(binary_accuracy(decide(scored(spark, sf))), "accuracy")


@CATALOG.add(
    "e3_precision_recall_f1",
    scored_sql("""SELECT round(sum(label * pred) / sum(pred), 6) AS precision, round(sum(label * pred) / sum(label), 6) AS recall,
                    round(2 * sum(label * pred) / (sum(pred) + sum(label)), 6) AS f1 FROM s"""),
)
def prf(spark, sf):
    return _rounded(binary_prf(decide(scored(spark, sf))), "precision", "recall", "f1")


@CATALOG.add(
    "e4_multilabel_f1",
    scored_sql("""SELECT 'micro' AS average, round(2 * (sum(label * pred) + sum(toxic * pred2))
                           / (sum(label) + sum(pred) + sum(toxic) + sum(pred2)), 6) AS f1 FROM s
                  UNION ALL
                  SELECT 'macro', round((2 * sum(label * pred) / (sum(label) + sum(pred))
                                       + 2 * sum(toxic * pred2) / (sum(toxic) + sum(pred2))) / 2, 6) FROM s"""),
)
def multilabel(spark, sf):
    rows = scored(spark, sf).select(
        F.array("label", "toxic").alias("y"),
        F.array((F.col("prob") > 0.5).cast("int"), (F.col("prob2") > 0.5).cast("int")).alias("pred"),
    )
    figures = [
        multilabel_f1(rows, 2, average).select(F.lit(average).alias("average"), F.round("f1", 6).alias("f1"))
        for average in ("micro", "macro")
    ]
    return figures[0].unionByName(figures[1])


_AUROC_SQL = """SELECT '{0}' AS scores, round(sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)), 6) AS auroc
  FROM (SELECT *, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
        FROM (SELECT {0} AS score, sum(label) AS pos, sum(1 - label) AS neg FROM s GROUP BY 1))"""


@CATALOG.add("e5_auroc", scored_sql(_AUROC_SQL.format("prob") + " UNION ALL " + _AUROC_SQL.format("tied")))
def roc(spark, sf):
    rows = scored(spark, sf)
    areas = [auroc(rows, prob=c).select(F.lit(c).alias("scores"), F.round("auroc", 6).alias("auroc")) for c in ("prob", "tied")]
    return areas[0].unionByName(areas[1])


_AUPRC_SQL = """SELECT '{0}' AS scores, round(sum(pos * tp / (tp + fp)) / sum(pos), 6) AS auprc
  FROM (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp
        FROM (SELECT {0} AS score, sum(label) AS pos, sum(1 - label) AS neg FROM s GROUP BY 1)
        WINDOW w AS (ORDER BY score DESC))"""


@CATALOG.add("e6_auprc", scored_sql(_AUPRC_SQL.format("prob") + " UNION ALL " + _AUPRC_SQL.format("tied")))
def pr(spark, sf):
    rows = scored(spark, sf)
    areas = [auprc(rows, prob=c).select(F.lit(c).alias("scores"), F.round("auprc", 6).alias("auprc")) for c in ("prob", "tied")]
    return areas[0].unionByName(areas[1])


@CATALOG.add(
    "e7_confusion",
    scored_sql("""SELECT a AS label, b AS pred, count(s.doc_id) AS n, round(count(s.doc_id) / (SELECT count(*) FROM s), 6) AS share
                  FROM (SELECT unnest([0, 0, 1, 1]) AS a, unnest([0, 1, 0, 1]) AS b) LEFT JOIN s ON label = a AND pred = b
                  GROUP BY a, b"""),
)
def cells(spark, sf):
    return _rounded(confusion(decide(scored(spark, sf))), "share")


_PRED = draw_sql("'pred'", "doc_id", "i - 1")


def _predicted(spark, sf):
    """Masked documents with predictions that are right seven times in ten."""
    guess = F.transform("labels", lambda t, i: F.when(draw("pred", F.col("doc_id"), i) < 0.7, t).otherwise(t + 1))
    return masked_documents(spark, sf).withColumn("preds", guess)


_SLOTS_SQL = MASKED_SQL + f""", tokens AS (
  SELECT doc_id, i, t, l, CASE WHEN {_PRED} < 0.7 THEN l ELSE l + 1 END AS p
  FROM (SELECT doc_id, unnest(input_ids) AS t, unnest(labels) AS l, generate_subscripts(labels, 1) AS i FROM masked))
"""


def _token_accuracy(name, condition, **options):
    @CATALOG.add(
        name, words_sql(_SLOTS_SQL + f"SELECT round(avg(CAST(l = p AS int)), 6) AS accuracy FROM tokens {condition}")
    )
    def run(spark, sf):
        return _rounded(token_accuracy(_predicted(spark, sf), **options), "accuracy")


_token_accuracy("e8_token_accuracy", "WHERE l <> -100")
_token_accuracy("e8_token_accuracy_all", "", ignore=None)


@CATALOG.add(
    "e9_slot_accuracy",
    words_sql(_SLOTS_SQL + """SELECT round(avg(a), 6) AS accuracy FROM (
                                SELECT avg(CAST(l = p AS int)) AS a FROM tokens WHERE t = 4 GROUP BY doc_id)"""),
)
def slots(spark, sf):
    return _rounded(slot_accuracy(_predicted(spark, sf)), "accuracy")


@CATALOG.add(
    "e10_slot_prefix_accuracy",
    words_sql(_SLOTS_SQL + """SELECT round(avg(a), 6) AS p_accuracy FROM (
                                SELECT avg(CAST(contains('w' || l, 'w' || (p % 100)) AS int)) AS a
                                FROM tokens WHERE t = 4 GROUP BY doc_id)"""),
)
def prefixes(spark, sf):
    rows = _predicted(spark, sf).withColumns(
        {
            "label_texts": F.transform("labels", lambda t: F.concat(F.lit("w"), t.cast("string"))),
            "pred_texts": F.transform(
                "preds", lambda t: F.concat(F.lit("w"), (t % 100).cast("string"), F.lit("_tail_"), t.cast("string"))
            ),
        }
    )
    return _rounded(slot_prefix_accuracy(rows), "p_accuracy")


_BCE_SQL = "greatest(logit, 0) - logit * label + ln(1 + exp(-abs(logit)))"


@CATALOG.add(
    "e11_bce",
    scored_sql(f"""SELECT 'mean' AS reduction, round(avg({_BCE_SQL}), 6) AS loss FROM s
                   UNION ALL SELECT 'sum', round(sum({_BCE_SQL}), 6) FROM s"""),
)
def bce(spark, sf):
    rows = scored(spark, sf)
    losses = [
        bce_from_logits(rows, reduction=r).select(F.lit(r).alias("reduction"), F.round("loss", 6).alias("loss"))
        for r in ("mean", "sum")
    ]
    return losses[0].unionByName(losses[1])


_TRUE_PROB = f"(({hash_sql(chr(39) + 'prob' + chr(39), 'doc_id', 'i - 1')} + 1) / 4294967296.0::double)"


@CATALOG.add(
    "e12_masked_ce",
    words_sql(_SLOTS_SQL + f"""SELECT 'mean' AS kind, round(avg(-ln({_TRUE_PROB})), 6) AS loss FROM tokens WHERE l <> -100
                               UNION ALL SELECT 'per 32', round(sum(-ln({_TRUE_PROB})) / 32, 5) FROM tokens WHERE l <> -100"""),
)
def cross_entropy(spark, sf):
    probs = F.transform("labels", lambda _, i: (hash32("prob", F.col("doc_id"), i) + 1) / F.lit(HASH_RANGE))
    rows = masked_documents(spark, sf).withColumn("probs", probs)
    mean = masked_ce(rows).select(F.lit("mean").alias("kind"), F.round("loss", 6).alias("loss"))
    return mean.unionByName(masked_ce(rows, denom=32).select(F.lit("per 32").alias("kind"), F.round("loss", 5).alias("loss")))


@CATALOG.add("e13_mse", scored_sql("SELECT round(avg((prob - label) * (prob - label)), 6) AS loss FROM s"))
def squared(spark, sf):
    return _rounded(mse(scored(spark, sf), value="prob"), "loss")


@CATALOG.add(
    "evaluation_report",
    scored_sql(f"""SELECT unnest(['accuracy', 'precision', 'recall', 'f1', 'loss']) AS metric,
                     unnest([round(avg(CAST(label = pred AS int)), 6), round(sum(label * pred) / sum(pred), 6),
                             round(sum(label * pred) / sum(label), 6),
                             round(2 * sum(label * pred) / (sum(pred) + sum(label)), 6), round(avg({_BCE_SQL}), 6)]) AS value FROM s
                   UNION ALL SELECT 'auroc', auroc FROM ({_AUROC_SQL.format('prob')})
                   UNION ALL SELECT 'auprc', auprc FROM ({_AUPRC_SQL.format('prob')})"""),
)
def report(spark, sf):
    return _rounded(evaluation_report(scored(spark, sf)), "value")


@CATALOG.add(
    "r1_score",
    words_sql("""SELECT doc_id, round(1 / (1 + exp(-(least(len(ids), 254) + 2 - 200) / 50.0::double)), 6) AS prob FROM ids"""),
)
def scores(spark, sf):
    def make_scorer():
        def scorer(batch):
            real = np.array([sum(mask) for mask in batch.attention_mask], dtype=float)
            return batch[["doc_id"]].assign(prob=1 / (1 + np.exp(-(real - 200) / 50)))

        return scorer

    rows = pad_sequence(encoded_documents(spark, sf)).select("doc_id", "attention_mask")
    return _rounded(score(rows, make_scorer, "doc_id long, prob double"), "prob")


def _tested(spark, sf):
    """Fitted on the train and valid parts, which share no customer with the test part."""
    rows = split(window_dataset(events(spark, sf), ROUTES, RULES), "column1")
    model = fit_labels(rows.filter("split <> 'test'"), max_iter=5)
    return predict_labels(model, rows.filter("split = 'test'"))


@CATALOG.add(
    "r2_label_rows",
    events_sql(f"""SELECT column1, column2, {flags_sql('mask')} AS y, true AS valid FROM frames
                   WHERE mask <> 0 AND {draw_sql('42', "'test'", 'column1')} < 0.2"""),
)
def label_rows(spark, sf):
    """The rows and labels of the test part; predictions are 0 or 1 and agree with probabilities from 0 to 1."""
    pairs = F.arrays_zip("probs", "preds")
    valid = F.forall(pairs, lambda p: p["probs"].between(0, 1) & (p["preds"] == (p["probs"] > 0.5).cast("int")))
    valid = valid & (F.size("probs") == F.size("y")) & (F.size("preds") == F.size("y"))
    return _tested(spark, sf).select("column1", "column2", F.array_join("y", ",").alias("y"), valid.alias("valid"))


@CATALOG.add("r2_label_baseline")
def label_baseline(spark, sf):
    tested = _tested(spark, sf)
    return tested.select(
        "column1",
        "column2",
        F.array_join("y", ",").alias("y"),
        F.array_join("preds", ",").alias("preds"),
        F.array_join(F.transform("probs", lambda p: F.round(p, 3).cast("string")), ",").alias("probs"),
    )


_BIGRAM_SQL = """
, seq AS (SELECT column1, evnt AS prev, lead(evnt) OVER (PARTITION BY column1 ORDER BY column2, column3, event_id) AS nxt
          FROM routed WHERE evnt IS NOT NULL),
model AS (SELECT prev, nxt, n FROM (
            SELECT prev, nxt, count(*) AS n, row_number() OVER (PARTITION BY prev ORDER BY count(*) DESC, nxt) AS r
            FROM seq WHERE nxt IS NOT NULL GROUP BY prev, nxt) WHERE r = 1)
"""


@CATALOG.add("r3_next_event_model", events_sql(_BIGRAM_SQL + 'SELECT prev, nxt AS "next", n FROM model'))
def bigrams(spark, sf):
    texts = to_text(customer_sequences(routed(spark, sf), part_size=25))
    return next_event_model(texts, "column1")


@CATALOG.add(
    "r3_fill_next",
    events_sql(_BIGRAM_SQL + """
    , cust AS (SELECT column1, list(evnt ORDER BY column2, column3, event_id) FILTER (evnt IS NOT NULL) AS ws
               FROM routed GROUP BY column1),
    held AS (SELECT column1, ws[len(ws) - 5] AS last, array_to_string(list_slice(ws, len(ws) - 4, len(ws)), ' ') AS targets
             FROM cust WHERE len(ws) > 5)
    SELECT column1, targets, concat_ws(' ', a.nxt, b.nxt, c.nxt, d.nxt, f.nxt) AS preds
    FROM held LEFT JOIN model a ON a.prev = last LEFT JOIN model b ON b.prev = a.nxt LEFT JOIN model c ON c.prev = b.nxt
    LEFT JOIN model d ON d.prev = c.nxt LEFT JOIN model f ON f.prev = d.nxt"""),
)
def filled(spark, sf):
    return _filled(spark, sf)


@CATALOG.add("r3_fill_next_in_parts", CATALOG.sql["r3_fill_next"])
def filled_in_parts(spark, sf):
    return _filled(spark, sf, part_size=10)


def _filled(spark, sf, **options):
    texts = to_text(customer_sequences(routed(spark, sf), **options))
    last = join_parts(split_tail(texts, "column1"), "column1", "history", n=1)
    rows = fill_next(next_event_model(texts, "column1"), last)
    return rows.select("column1", F.array_join("targets", " ").alias("targets"), F.array_join("preds", " ").alias("preds"))
