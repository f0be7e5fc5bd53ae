"""Window, feature, model and evaluation queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import text
from ..operators import evaluate as ev, features as ft, heavy, pca, scoring, windows as wd
from ..session import scratch_folder
from ..sinks import artefacts, topics as sink
from . import training, views as v
from .catalog import query

_WIN = f"WITH {v.SQL_WINDOWS}"


@query(f"{_WIN} SELECT source, host, first_id, event_id AS last_id, label FROM wins")
def sliding_windows(spark, sf):
    found = wd.sliding_windows(v.enriched(spark, sf), v.ORDER, row_id="event_id")
    return found.select("source", "host", "first_id", "last_id", "label")


@query(f"{_WIN} SELECT source, host, event_id AS last_id, label FROM wins")
def window_labels(spark, sf):
    return wd.window_labels(v.enriched(spark, sf), v.ORDER).select("source", "host", F.col("event_id").alias("last_id"), "label")


@query(f"{_WIN} SELECT source, host, event_id AS last_id FROM wins WHERE NOT label")
def normal_windows(spark, sf):
    return wd.window_labels(v.enriched(spark, sf), v.ORDER).where(~F.col("label")).select(
        "source", "host", F.col("event_id").alias("last_id"))


@query(f"{_WIN} SELECT count(*) AS windows, count(*) FILTER (WHERE NOT label) AS normal, count(*) FILTER (WHERE label) AS anomalous FROM wins")
def window_counts(spark, sf):
    return wd.window_counts(wd.window_labels(v.enriched(spark, sf), v.ORDER))


@query(f"WITH {v.SQL_ENRICHED} SELECT count(DISTINCT (source, host)) AS active_keys FROM enriched")
def active_keys(spark, sf):
    return wd.active_keys(v.enriched(spark, sf))


# ---- Features --------------------------------------------------------------

_WORDS = """words AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM documents),
counted AS (SELECT token, count(*) AS n FROM words GROUP BY token)"""


def _vocab_sql(size: int) -> str:
    return f"vocab AS (SELECT token, n, CAST(row_number() OVER (ORDER BY n DESC, token) AS INTEGER) AS idx FROM counted ORDER BY n DESC, token LIMIT {size})"


def _words(spark, sf):
    docs = v.table(spark, sf, "documents")
    return docs.select("doc_id", F.explode(text.tokens(F.col("text"))).alias("token"))


@query(f"WITH {_WORDS}, {_vocab_sql(ft.VOCAB_SIZE)} SELECT token, n, idx FROM vocab")
def build_vocabulary(spark, sf):
    return ft.build_vocabulary(v.table(spark, sf, "documents"), "text")


@query(f"""WITH {v.SQL_ENRICHED}, w AS (SELECT event_id, unnest(regexp_extract_all(lower(message), '[a-z0-9]+')) AS token FROM enriched),
c AS (SELECT token, count(*) AS n, min(event_id) AS first_id FROM w GROUP BY token),
f AS (SELECT e.event_id, list_position(regexp_extract_all(lower(e.message), '[a-z0-9]+'), c.token) AS pos, c.token, c.n FROM c JOIN enriched e ON e.event_id = c.first_id)
SELECT token, n, CAST(row_number() OVER (ORDER BY n DESC, event_id, pos) AS INTEGER) AS idx FROM f ORDER BY n DESC, event_id, pos LIMIT {ft.VOCAB_SIZE}""")
def build_vocabulary_first_seen(spark, sf):
    return ft.build_vocabulary(v.enriched(spark, sf), order_by="event_id")


@query(f"WITH {_WORDS}, {_vocab_sql(ft.VOCAB_SIZE)} SELECT token, n, idx FROM vocab")
def build_vocabulary_heavy(spark, sf):
    """The same tokens from bounded summaries of each task and an exact recount of candidates."""
    return heavy.frequent_tokens(v.table(spark, sf, "documents"), "text")


@query(f"""WITH {_WORDS}, {_vocab_sql(ft.VOCAB_SIZE)} SELECT w.doc_id, w.token, coalesce(v.idx, 0) AS idx, count(*) AS n
FROM words w LEFT JOIN vocab v ON w.token = v.token GROUP BY ALL""")
def vocab_lookup(spark, sf):
    docs = v.table(spark, sf, "documents")
    return ft.lookup_counts(docs, "doc_id", "text", ft.build_vocabulary(docs, "text"))


@query(f"""WITH {_WORDS}, {_vocab_sql(ft.VOCAB_SIZE)} SELECT count(*) AS tokens, count(v.idx) AS known,
  round(avg(CASE WHEN v.idx IS NULL THEN 0.0 ELSE 1.0 END), 9) AS coverage FROM words w LEFT JOIN vocab v ON w.token = v.token""")
def vocab_coverage(spark, sf):
    vocabulary = ft.build_vocabulary(v.table(spark, sf, "documents"), "text")
    return ft.coverage(_words(spark, sf), vocabulary).withColumn("coverage", F.round("coverage", 9))


_ONE_HOT_SQL = ", ".join(
    [f"CAST(CASE WHEN source = '{s}' THEN 1 ELSE 0 END AS INTEGER) AS source_{s}" for s in ft.SOURCES]
    + [f"CAST(CASE WHEN level = '{x}' THEN 1 ELSE 0 END AS INTEGER) AS level_{x.lower()}" for x in ft.LEVELS])
_ONE_HOT_NAMES = [f"source_{s}" for s in ft.SOURCES] + [f"level_{x.lower()}" for x in ft.LEVELS]


@query(f"WITH {v.SQL_ENRICHED} SELECT event_id, {_ONE_HOT_SQL} FROM enriched")
def one_hot_source_level(spark, sf):
    hot = ft.one_hot(F.col("source"), ft.SOURCES) + ft.one_hot(F.col("level"), ft.LEVELS)
    return v.enriched(spark, sf).select("event_id", *[c.cast("int").alias(n) for c, n in zip(hot, _ONE_HOT_NAMES)])


@query(f"WITH {v.SQL_ENRICHED} SELECT event_id, round(sin(2 * pi() * hour / 24), 6) + 0.0 AS hour_sin, round(cos(2 * pi() * hour / 24), 6) + 0.0 AS hour_cos FROM enriched")
def hour_cyclic(spark, sf):
    sin, cos = ft.hour_cycle(F.col("hour"))
    return v.enriched(spark, sf).select(
        "event_id", (F.round(sin, 6) + F.lit(0.0)).alias("hour_sin"), (F.round(cos, 6) + F.lit(0.0)).alias("hour_cos"))


_DIMS = ft.EMBED_DIM


def _exact_table(size: int) -> np.ndarray:
    """A table of the production size that SQL can write too: eighths, which floats hold exactly; unknown tokens are zero."""
    rank, dim = np.arange(size + 1)[:, None], np.arange(_DIMS)[None, :]
    return np.where(rank == 0, 0, ((rank * (2 * dim + 1)) % 17 - 8) / 8).astype(np.float32)


def _exact_sql(d: int) -> str:
    return f"CAST(CAST(coalesce(avg(CASE WHEN idx = 0 THEN 0.0 ELSE ((idx * {2 * d + 1}) % 17 - 8) / CAST(8 AS DOUBLE) END), 0.0) AS FLOAT) AS DOUBLE)"


@query(f"""WITH {_WORDS}, {_vocab_sql(ft.VOCAB_SIZE)}, placed AS (SELECT w.doc_id, coalesce(v.idx, 0) AS idx FROM words w LEFT JOIN vocab v ON w.token = v.token)
SELECT d.doc_id, {', '.join(f"coalesce(m.e{i}, 0.0) AS e{i}" for i in range(_DIMS))}
FROM documents d LEFT JOIN (SELECT doc_id, {', '.join(f'{_exact_sql(i)} AS e{i}' for i in range(_DIMS))} FROM placed GROUP BY doc_id) m ON d.doc_id = m.doc_id""")
def message_embedding(spark, sf):
    """All 64 values of the mean embedding of whole texts."""
    docs = v.table(spark, sf, "documents")
    encoder = ft.collect_encoder(ft.build_vocabulary(docs, "text"), _exact_table(ft.VOCAB_SIZE))
    embed = ft.message_embedding(spark, encoder)
    return ft.value_columns(docs.select("doc_id", embed(F.col("text")).alias("e")), "e", "e", _DIMS, ["doc_id"])


def _encoder(spark, sf):
    return ft.collect_encoder(ft.build_vocabulary(v.dealt_enriched(spark, sf)), _exact_table(ft.VOCAB_SIZE))


def _shown_vectors(vectors):
    return ft.value_columns(vectors, "vector", "v", ft.N_FEATURES, ["event_id"], digits=4)


_PLAIN_SQL = [f"CASE WHEN source = '{s}' THEN 1.0 ELSE 0.0 END" for s in ft.SOURCES] + [
    f"CASE WHEN level = '{x}' THEN 1.0 ELSE 0.0 END" for x in ft.LEVELS] + ["sin(2 * pi() * hour / 24)", "cos(2 * pi() * hour / 24)"]
_VECTOR_SQL = f"""{v.SQL_ENRICHED}, said AS (SELECT event_id, unnest(regexp_extract_all(lower(message), '[a-z0-9]+')) AS token FROM enriched),
known AS (SELECT token, row_number() OVER (ORDER BY count(*) DESC, token) AS idx FROM said GROUP BY token ORDER BY count(*) DESC, token LIMIT {ft.VOCAB_SIZE}),
means AS (SELECT event_id, {', '.join(f'{_exact_sql(i)} AS e{i}' for i in range(_DIMS))}
  FROM (SELECT s.event_id, coalesce(k.idx, 0) AS idx FROM said s LEFT JOIN known k ON s.token = k.token) GROUP BY event_id),
vec AS (SELECT enriched.event_id, is_anomaly_candidate, day, {', '.join(f'CAST(CAST({e} AS FLOAT) AS DOUBLE) AS v{i}' for i, e in enumerate(_PLAIN_SQL))},
  {', '.join(f'coalesce(e{i}, 0.0) AS v{i + ft.PLAIN_DIMS}' for i in range(_DIMS))} FROM enriched LEFT JOIN means USING (event_id)),
tall AS (UNPIVOT vec ON {', '.join(f'v{i}' for i in range(ft.N_FEATURES))} INTO NAME name VALUE x)"""


def _fit_sql(where: str = "TRUE") -> str:
    return f"""fit AS (SELECT CAST(substr(name, 2) AS INTEGER) AS dim, avg(x) AS mean, CASE WHEN stddev_pop(x) = 0 THEN 1.0 ELSE stddev_pop(x) END AS scale
  FROM tall WHERE NOT is_anomaly_candidate AND {where} GROUP BY ALL)"""


@query(f"""WITH {_VECTOR_SQL} SELECT event_id, {', '.join(f'round(v{i}, 4) + 0.0 AS v{i}' for i in range(ft.N_FEATURES))} FROM vec""")
def log_vector(spark, sf):
    """All 77 values of every row's vector."""
    return _shown_vectors(ft.log_vectors(v.dealt_enriched(spark, sf), _encoder(spark, sf)))


def _rounded_fit(fitted):
    return fitted.select("dim", (F.round("mean", 5) + F.lit(0.0)).alias("mean"), F.round("scale", 5).alias("scale"))


@query(f"WITH {_VECTOR_SQL}, {_fit_sql()} SELECT dim, round(mean, 5) + 0.0 AS mean, round(scale, 5) AS scale FROM fit")
def fit_scaler(spark, sf):
    """The production scaler: 77 means and deviations of the normal rows."""
    return _rounded_fit(ft.fit_log_scaler(v.dealt_enriched(spark, sf), _encoder(spark, sf)))


@query(f"WITH {_VECTOR_SQL}, {_fit_sql('day BETWEEN 5 AND 20 AND day <> 11')} SELECT dim, round(mean, 5) + 0.0 AS mean, round(scale, 5) AS scale FROM fit")
def fit_scaler_from_days(spark, sf):
    """A scaler of some days from stored moments by day: added up, and one day taken out again."""
    folder = f"{scratch_folder(spark)}/moments"
    ft.log_moments(v.dealt_enriched(spark, sf), _encoder(spark, sf), by_day=True).write.partitionBy("date").parquet(folder)
    stored = spark.read.parquet(folder)
    days = stored.where(F.dayofmonth("date").between(5, 20))
    whole, one = ft.merge_moments(days), ft.merge_moments(days.where(F.dayofmonth("date") == 11))
    return _rounded_fit(ft.scaler_of(ft.subtract_moments(whole, one)))


@query(f"""WITH {_VECTOR_SQL}, {_fit_sql()}, scaled AS (SELECT event_id, dim, round(CAST(CAST((x - mean) / scale AS FLOAT) AS DOUBLE), 4) + 0.0 AS y
  FROM tall JOIN fit ON dim = CAST(substr(name, 2) AS INTEGER))
SELECT event_id, {', '.join(f'max(y) FILTER (WHERE dim = {i}) AS v{i}' for i in range(ft.N_FEATURES))} FROM scaled GROUP BY event_id""")
def scale_vector(spark, sf):
    """All 77 scaled values, on the path that models take."""
    rows, encoder = v.dealt_enriched(spark, sf), _encoder(spark, sf)
    return _shown_vectors(ft.scaled_log_vectors(rows, encoder, ft.collect_scaler(ft.fit_log_scaler(rows, encoder))))


# ---- Scores, thresholds, evaluation ----------------------------------------

@query(f"{_WIN} SELECT round(quantile_cont(score, 0.95), 9) AS threshold, count(*) AS n_samples FROM wins WHERE NOT label")
def fit_threshold(spark, sf):
    fitted = ev.fit_threshold(v.scored_windows(spark, sf).where(~F.col("label")))
    return fitted.select(F.round("threshold", 9).alias("threshold"), "n_samples")


@query(f"{_WIN} SELECT label, count(*) AS n, true AS within FROM wins GROUP BY label")
def sketch_thresholds(spark, sf):
    """Percentiles of scores out of stored sketches by day and label, merged: their true ranks are within the stated bound."""
    scored, folder = v.scored_windows(spark, sf), f"{scratch_folder(spark)}/sketches"
    ev.score_sketches(scored.withColumn("date", F.to_date("event_time")), "date", "label").write.parquet(folder)
    found = ev.sketch_percentile(spark.read.parquet(folder), ev.THRESHOLD_PERCENTILE, "label")
    rank = F.avg((F.col("score") <= F.col("threshold")).cast("double"))
    told = scored.join(F.broadcast(found), "label").groupBy("label", "n").agg(rank.alias("rank"), F.avg((F.col("score") < F.col("threshold")).cast("double")).alias("below"))
    goal, bound = ev.THRESHOLD_PERCENTILE / 100, ev.SKETCH_ERROR
    return told.select("label", "n", ((F.col("rank") >= goal - bound) & (F.col("below") <= goal + bound)).alias("within"))


@query(f"""{_WIN} SELECT CAST(t AS DOUBLE) AS threshold, label, count(*) AS n, true AS within
FROM wins, (SELECT CAST(unnest([0.4528, 0.5, 0.763474, 1.3071, 2.0]) AS DOUBLE) AS t) GROUP BY ALL""")
def sketch_sweep(spark, sf):
    """Windows above each threshold out of the merged sketches, against the exact counts."""
    scored = v.scored_windows(spark, sf)
    swept = ev.sketch_sweep(ev.score_sketches(scored.withColumn("date", F.to_date("event_time")), "date", "label"), SWEEP, "label")
    exact = ev.threshold_sweep(scored, SWEEP).select("threshold", F.inline(F.array(
        F.struct(F.lit(True).alias("label"), F.col("tp").alias("above")), F.struct(F.lit(False).alias("label"), F.col("fp").alias("above")))))
    both = swept.join(F.broadcast(exact.withColumnRenamed("above", "exact")), ["threshold", "label"])
    return both.select("threshold", "label", "n", (F.abs(F.col("above") - F.col("exact")) <= ev.SKETCH_ERROR * F.col("n") + 1).alias("within"))


@query(f"{_WIN} SELECT event_id AS last_id, source, host, round(score, 6) AS score FROM wins WHERE score > {v.THRESHOLD}")
def ml_anomalies(spark, sf):
    return ev.ml_anomalies(v.scored_windows(spark, sf), v.THRESHOLD).select(
        F.col("event_id").alias("last_id"), "source", "host", F.round("score", 6).alias("score"))


_PRED = f"{_WIN}, pred AS (SELECT *, score > {v.THRESHOLD} AS predicted FROM wins)"


def _predicted(spark, sf):
    return ev.predict(v.scored_windows(spark, sf), v.THRESHOLD)


@query(f"{_PRED} SELECT CAST(label AS INTEGER) AS truth, CAST(predicted AS INTEGER) AS prediction, count(*) AS n FROM pred GROUP BY ALL")
def confusion_matrix(spark, sf):
    return ev.confusion_matrix(_predicted(spark, sf))


@query(f"""{_PRED}, c AS (SELECT CAST(count(*) FILTER (WHERE NOT label AND NOT predicted) AS DOUBLE) AS tn, CAST(count(*) FILTER (WHERE NOT label AND predicted) AS DOUBLE) AS fp,
  CAST(count(*) FILTER (WHERE label AND NOT predicted) AS DOUBLE) AS fn, CAST(count(*) FILTER (WHERE label AND predicted) AS DOUBLE) AS tp FROM pred),
s AS (SELECT *, tn / (tn + fn) AS p0, tn / (tn + fp) AS r0, tp / (tp + fp) AS p1, tp / (tp + fn) AS r1, tn + fp AS s0, tp + fn AS s1 FROM c),
f AS (SELECT *, 2 * p0 * r0 / (p0 + r0) AS f0, 2 * p1 * r1 / (p1 + r1) AS f1, s0 + s1 AS n, (tn + tp) / (s0 + s1) AS acc FROM s),
r AS (SELECT 'Normal' AS class, p0 AS p, r0 AS r, f0 AS f, s0 AS n FROM f UNION ALL SELECT 'Anomalie', p1, r1, f1, s1 FROM f UNION ALL SELECT 'accuracy', acc, acc, acc, n FROM f
 UNION ALL SELECT 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n FROM f
 UNION ALL SELECT 'weighted avg', (p0 * s0 + p1 * s1) / n, (r0 * s0 + r1 * s1) / n, (f0 * s0 + f1 * s1) / n, n FROM f)
SELECT class, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, CAST(n AS BIGINT) AS support FROM r""")
def classification_report(spark, sf):
    report = ev.classification_report(_predicted(spark, sf))
    return report.select("class", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


@query(f"""{_WIN}, l AS (SELECT least(max(score), 3 * CAST({v.THRESHOLD} AS DOUBLE)) AS lim FROM wins), i AS (SELECT label, least(floor(score / (lim / 79)), 78) AS bin, lim / 79 AS width FROM wins, l WHERE score >= 0 AND score <= lim),
c AS (SELECT label, CAST(bin AS BIGINT) AS bin, width, count(*) AS n FROM i GROUP BY ALL)
SELECT label, bin, n, round(n / (sum(n) OVER (PARTITION BY label) * width), 6) AS density FROM c""")
def score_histogram(spark, sf):
    return ev.score_histogram(v.scored_windows(spark, sf), v.THRESHOLD).select("label", "bin", "n", F.round("density", 6).alias("density"))


@query(f"{_PRED} SELECT count(*) AS windows, count(*) FILTER (WHERE predicted) AS detected, round(100.0 * count(*) FILTER (WHERE predicted) / count(*), 6) AS detected_pct FROM pred")
def detection_rate(spark, sf):
    return ev.detection_rate(v.scored_windows(spark, sf), v.THRESHOLD).withColumn("detected_pct", F.round("detected_pct", 6))


SWEEP = [0.4528, 0.5, 0.763474, 1.3071, 2.0]


@query(f"""{_WIN} SELECT CAST(t AS DOUBLE) AS threshold, count(*) FILTER (WHERE label AND score > t) AS tp, count(*) FILTER (WHERE NOT label AND score > t) AS fp,
  count(*) FILTER (WHERE label AND score <= t) AS fn, count(*) FILTER (WHERE NOT label AND score <= t) AS tn
FROM wins, (SELECT CAST(unnest({SWEEP}) AS DOUBLE) AS t) GROUP BY t""")
def threshold_sweep(spark, sf):
    return ev.threshold_sweep(v.scored_windows(spark, sf), SWEEP)


@query(f"{_PRED} SELECT source, host, event_id, predicted, label FROM pred")
def align_predictions(spark, sf):
    key = ["source", "host", "event_id"]
    predictions = _predicted(spark, sf).select(*key, "predicted")
    truth = wd.window_labels(v.enriched(spark, sf), v.ORDER).select(*key, "label")
    return ev.align_predictions(predictions, truth, key)


_PAYLOAD = "detected_at, source, host, anomaly_score, threshold, severity_ratio, model_version"


@query(f"WITH {v.SQL_ANOMALIES} SELECT arrival, {_PAYLOAD}, CAST(10 AS INTEGER) AS sequence_rows, message AS last_message FROM anomalies")
def ml_payload(spark, sf):
    return v.ml_anomalies(spark, sf).select(
        "arrival", *_PAYLOAD.split(", "), F.size("sequence").alias("sequence_rows"),
        F.element_at("sequence", -1)["message"].alias("last_message"))


@query(f"""WITH {v.SQL_ANOMALIES} SELECT source AS key, detected_at, host, anomaly_score, severity_ratio, model_version, message AS last_message FROM anomalies""")
def ml_anomaly_messages(spark, sf):
    sent = sink.anomaly_messages(v.ml_anomalies(spark, sf).drop("arrival"))
    field = {c: F.get_json_object("value", f"$.{c}") for c in ("detected_at", "host", "model_version")}
    number = {c: F.get_json_object("value", f"$.{c}").cast("double") for c in ("anomaly_score", "severity_ratio")}
    last = F.get_json_object("value", "$.sequence[9].message")
    return sent.select("key", *[c.alias(n) for n, c in {**field, **number}.items()], last.alias("last_message"))


@query(v.SQL_RULE_HITS)
def scored_payload(spark, sf):
    """Rows to vectors, windows, scores, hits with their sequences, and payload, all on the path a fitted model takes."""
    rows = v.enriched(spark, sf)
    inputs, model = v.rule_scorer(spark, sf)
    hits = scoring.anomalies_of(rows, inputs, model, v.ORDER, v.RULE_THRESHOLD, ["timestamp", "level", "message"])
    sent = sink.anomaly_payload(hits, v.RULE_THRESHOLD, v.BATCH_ISO, F.element_at("sequence", -1)["timestamp"])
    return sent.select("source", "host", "anomaly_score", "severity_ratio", F.array_join("sequence.message", "|").alias("messages"))


# ---- Fitted models: what SQL cannot fit -------------------------------------

@query(f"""{_WIN}, placed AS (SELECT *, CAST(concat('0x', substr(md5(concat_ws('|', source, host, epoch_us(event_time), event_id, '{scoring.SPLIT_SEED}')), 1, 8)) AS BIGINT) AS place FROM wins)
SELECT source, host, event_id AS last_id, CASE WHEN label THEN 'none' WHEN place % 10000 < {int(scoring.VALIDATION_SHARE * 10_000)} THEN 'validation' ELSE 'train' END AS side FROM placed""")
def train_val_split(spark, sf):
    """Windows with the side of the split they belong to (anomalous ones on neither)."""
    labelled = wd.window_labels(v.enriched(spark, sf), v.ORDER)
    identity = ["source", "host", *v.ORDER]
    side = F.when(F.col("label"), F.lit("none")).when(scoring.in_validation(labelled, identity), F.lit("validation"))
    return labelled.select("source", "host", F.col("event_id").alias("last_id"), side.otherwise(F.lit("train")).alias("side"))


def _fitted(spark, sf, kind="pca", **options):
    return training.fit(v.dealt_enriched(spark, sf), v.ORDER, v.BATCH_ISO, kind, **options)


@query()
def pca_scores(spark, sf):
    """Reconstruction error of every window under a model fitted on normal training windows."""
    return _fitted(spark, sf).scored


@query(f"""{_WIN}, placed AS (SELECT *, CAST(concat('0x', substr(md5(concat_ws('|', source, host, epoch_us(event_time), event_id, '{scoring.SPLIT_SEED}')), 1, 8)) AS BIGINT) % 10000 < {int(scoring.VALIDATION_SHARE * 10_000)} AS val FROM wins)
SELECT source, host, count(*) AS windows, count(*) FILTER (WHERE label) AS anomalous, count(*) FILTER (WHERE label OR val) AS held_out FROM placed GROUP BY source, host""")
def scored_window_counts(spark, sf):
    """What the fitted model scored: windows, anomalous and held-out ones per source and host."""
    scored = _fitted(spark, sf).scored
    return scored.groupBy("source", "host").agg(
        F.count("*").alias("windows"), F.count_if(F.col("label")).alias("anomalous"),
        F.count_if(F.col("label") | F.col("in_validation")).alias("held_out"))


_SPLIT = f"""placed AS (SELECT *, CAST(concat('0x', substr(md5(concat_ws('|', source, host, epoch_us(event_time), event_id, '{scoring.SPLIT_SEED}')), 1, 8)) AS BIGINT) % 10000 < {int(scoring.VALIDATION_SHARE * 10_000)} AS val FROM wins)"""


@query(f"""{_WIN}, {_SPLIT}, t AS (SELECT DISTINCT unnest(regexp_extract_all(lower(message), '[a-z0-9]+')) AS token FROM enriched)
SELECT {ev.THRESHOLD_PERCENTILE} AS percentile, '{v.BATCH_ISO}' AS computed_at, (SELECT count(*) FROM placed WHERE NOT label AND val) AS n_samples,
  {ft.N_FEATURES} AS n_features, {wd.SEQ_LEN} AS seq_len, CAST(NULL AS INTEGER) AS hidden_size, {pca.LATENT} AS latent_size, CAST(NULL AS INTEGER) AS num_layers,
  CAST(NULL AS DOUBLE) AS dropout, CAST(least((SELECT count(*) FROM t), {ft.VOCAB_SIZE}) AS INTEGER) AS vocab_size, {ft.EMBED_DIM} AS embed_dim,
  CAST(NULL AS DOUBLE) AS train_loss, CAST(NULL AS DOUBLE) AS val_loss, CAST(NULL AS DOUBLE) AS best_val_loss, true AS has_threshold""")
def model_metadata(spark, sf):
    """All facts of a fitted model; of the threshold, which depends on its weights, that it is there."""
    found = training.metadata_frame(spark, _fitted(spark, sf).metadata)
    return found.withColumn("has_threshold", F.col("threshold") > 0).drop("threshold")


@query(f"""WITH {_VECTOR_SQL}, wins AS (SELECT * FROM (SELECT *, count(*) OVER w AS window_rows, bool_or(is_anomaly_candidate) OVER w AS label,
  row_number() OVER (PARTITION BY source, host ORDER BY event_time, event_id) AS place FROM enriched
  WINDOW w AS (PARTITION BY source, host ORDER BY event_time, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))),
{_SPLIT}, used AS (SELECT source, host, place FROM placed WHERE window_rows = 10 AND NOT label AND NOT val),
steps AS (SELECT w.event_id, 9 - (u.place - w.place) AS step FROM used u JOIN wins w ON w.source = u.source AND w.host = u.host AND w.place BETWEEN u.place - 9 AND u.place),
cells AS (SELECT CAST(step * {ft.N_FEATURES} + CAST(substr(name, 2) AS INTEGER) AS INTEGER) AS i, x FROM steps JOIN tall USING (event_id))
SELECT i, count(*) AS n, round(avg(x), 6) + 0.0 AS mean, round(avg(x * x), 6) + 0.0 AS square FROM cells GROUP BY i""")
def pca_moments(spark, sf):
    """What the linear model is fitted on: number, mean and mean square of each of a training window's 770 values."""
    inputs = scoring.Inputs(_encoder(spark, sf), None)
    source = scoring.window_source(v.dealt_enriched(spark, sf), v.ORDER, wd.HOT_ROWS)
    sums = pca.product_sums(source, inputs)
    own = F.element_at("product", F.col("i") + 1) / F.col("n")
    return sums.select("i", "n", (F.round(F.col("total") / F.col("n"), 6) + F.lit(0.0)).alias("mean"), (F.round(own, 6) + F.lit(0.0)).alias("square"))


@query(f"{_WIN} SELECT source, host, event_id AS last_id, true AS same FROM wins")
def artefact_round_trip(spark, sf):
    """A fitted model saved as tables and loaded again gives every window the score it had."""
    folder, fitted = scratch_folder(spark), _fitted(spark, sf)
    artefacts.save_model(spark, folder, fitted.inputs, fitted.model, fitted.metadata)
    inputs, model, facts = artefacts.load_model(spark, folder)
    again = scoring.score_source(fitted.source, inputs, model, v.ORDER)
    key = ["source", "host", "event_id"]
    both = fitted.scored.select(*key, "score").join(again.select(*key, F.col("score").alias("again")), key)
    same = (F.col("score") == F.col("again")) & F.lit(facts["threshold"] == fitted.threshold)
    return both.select("source", "host", F.col("event_id").alias("last_id"), same.alias("same"))


@query()
def model_report(spark, sf):
    """Quality of the fitted linear model on all and on held-out windows."""
    fitted = _fitted(spark, sf)
    return training.evaluate(fitted.scored, fitted.threshold)


@query()
def anomalous_hosts(spark, sf):
    """Sources and hosts by how many of their windows exceed the fitted threshold."""
    fitted = _fitted(spark, sf)
    hit = F.col("score") > F.lit(fitted.threshold)
    return (
        fitted.scored.groupBy("source", "host")
        .agg(F.count("*").alias("windows"), F.count_if(hit).alias("detected"), F.max("score").alias("worst"))
        .orderBy(F.desc("detected"), "source", "host")
    )
