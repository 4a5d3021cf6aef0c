"""Queries over labels, splits, TF-IDF, scaling, models, inference and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.domains import EMOJI_RANGES, ERROR_NEGATIONS, FINE_LABELS, INVERSE, LABELS, PRIORITY_LABELS, ROMANIAN_LABELS, SARCASM_MARKS
from ..operators import emotions, evaluate, labels, models, predict, ranks, scaling, tfidf
from ..sources import corpora
from .base import CUES, lexicon, query, table, values
from .lexicon_queries import _features_sql, lexicon_features

_FINE = "[" + ", ".join(f"'{n}'" for n in FINE_LABELS) + "]"
_FINE_MAP = f"fine(label, target) AS ({values(FINE_LABELS.items())})"


# ---- labels ----
@query(
    "map_labels_28",
    f"""WITH {_FINE_MAP}, c AS (SELECT event_id, user_id % 31 AS id FROM events)
    SELECT event_id, f.target AS label FROM c JOIN fine f ON id < 28 AND f.label = {_FINE}[id + 1]""",
)
def map_labels_28(spark, sf):
    ids = table(spark, sf, "events").select("event_id", F.array((F.col("user_id") % 31).cast("int")).alias("labels"))
    return ids.select("event_id", labels.first_fine(F.col("labels")).alias("label")).where("label IS NOT NULL")


@query(
    "map_labels_first_mappable",
    f"""WITH {_FINE_MAP}, c AS (SELECT event_id, user_id % 40 AS a, event_id % 35 AS b FROM events)
    SELECT event_id, target AS label FROM c JOIN fine f ON f.label = {_FINE}[CASE WHEN a < 28 THEN a ELSE b END + 1] WHERE a < 28 OR b < 28""",
)
def map_labels_first_mappable(spark, sf):
    ids = F.array((F.col("user_id") % 40).cast("int"), (F.col("event_id") % 35).cast("int"))
    return table(spark, sf, "events").select("event_id", labels.first_mappable(ids).alias("label")).where("label IS NOT NULL")


_BOTH = [*[(x, x) for x in LABELS], *ROMANIAN_LABELS.items()]
_NAMES = ["Furie", "frică ", "JOY", "tristețe", "none", "neutru", "Trust"]


@query(
    "map_labels_red",
    f"""WITH m(label, target) AS ({values(_BOTH)}), c AS (SELECT event_id, ['{"', '".join(_NAMES)}'][user_id % 7 + 1] AS name FROM events)
    SELECT event_id, target AS label FROM c JOIN m ON m.label = lower(trim(name))""",
)
def map_labels_red(spark, sf):
    name = F.get(F.array(*map(F.lit, _NAMES)), (F.col("user_id") % 7).cast("int"))
    return table(spark, sf, "events").select("event_id", labels.bilingual_target(name).alias("label")).where("label IS NOT NULL")


_PRIORITY_SQL = " ".join(f"WHEN user_id % {i + 3} = 0 THEN '{p.lower()}'" for i, p in enumerate(PRIORITY_LABELS))


@query(
    "red_priority_label",
    f"""SELECT event_id, CASE {_PRIORITY_SQL} WHEN event_id % 9 < 7 THEN lower(['Sadness', 'Surprise', 'Fear', 'Anger', 'Neutral', 'Trust', 'Joy'][event_id % 9 + 1])
      ELSE 'joy' END AS label FROM events""",
)
def red_priority_label(spark, sf):
    rows = table(spark, sf, "events").select(
        "event_id",
        F.lit("x").alias("text"),
        *[(F.col("user_id") % (i + 3) == 0).alias(p) for i, p in enumerate(PRIORITY_LABELS)],
        F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: F.when(F.col("event_id") % 9 == i, 1).otherwise(0)).alias("agreed"),
    )
    label = labels.priority_label({p: F.col(p) for p in PRIORITY_LABELS}, F.col("agreed"), F.lit("bucurie"))
    return rows.select("event_id", labels.bilingual_target(label).alias("label"))


@query("usable_texts", "SELECT doc_id FROM documents WHERE trim(text) <> '' AND trim(lang) <> ''")
def usable_texts(spark, sf):
    return labels.usable(table(spark, sf, "documents"), "text", "lang").select("doc_id")


@query("corpus_union", "SELECT label, CAST(count(*) AS BIGINT) AS n FROM (SELECT lang AS label FROM documents UNION ALL SELECT role FROM conversations) GROUP BY label")
def corpus_union(spark, sf):
    both = table(spark, sf, "documents").select(F.col("lang").alias("label")).unionByName(table(spark, sf, "conversations").select(F.col("role").alias("label")))
    return both.groupBy("label").agg(F.count("*").alias("n"))


@query("label_index", "SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT event_type AS label FROM events)")
def label_index(spark, sf):
    return labels.label_index(table(spark, sf, "events"), "event_type")


@query("class_weights", "SELECT lang AS label, CAST(count(*) AS BIGINT) AS n, round(sum(count(*)) OVER ()::DOUBLE / (count(*) OVER () * count(*)), 9) AS weight FROM documents GROUP BY lang")
def class_weights(spark, sf):
    return labels.class_weights(table(spark, sf, "documents"), "lang").withColumn("weight", F.round("weight", 9))


@query("common_labels", "SELECT DISTINCT n_name AS label FROM nation WHERE n_name IN (SELECT upper(n_name) FROM nation WHERE n_regionkey < 3)")
def common_labels(spark, sf):
    n = table(spark, sf, "nation")
    return labels.common_labels(n.select(F.col("n_name").alias("label")), n.where("n_regionkey < 3").select(F.upper("n_name").alias("label")))


@query(
    "stratified_split",
    """WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents)
    SELECT doc_id, lang, CASE WHEN r * 100 <= n * 20 THEN 'test' WHEN r * 100 <= n * 30 THEN 'val' ELSE 'train' END AS split FROM r""",
)
def stratified_split(spark, sf):
    return ranks.stratified_split(table(spark, sf, "documents").select("doc_id", "lang"), "lang", "doc_id").select("doc_id", "lang", "split")


# ---- TF-IDF, on conversations ----
def _conversations(spark, sf):
    return table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text", "role")


_DOCS = "docs AS (SELECT conv_id * 1000 + turn AS doc_id, coalesce(text, '') AS text, role FROM conversations)"


def _word_terms(high: int) -> str:
    parts = []
    for n in range(1, high + 1):
        joined = f"array_to_string(w[i:i + {n - 1}], ' ')"
        parts.append(f"SELECT doc_id, {joined} AS term FROM (SELECT doc_id, w, unnest(range(1, len(w) - {n - 2})) AS i FROM toks WHERE len(w) >= {n})")
    return r"toks AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM docs), grams AS (" + " UNION ALL ".join(parts) + ")"


def _char_terms(low: int, high: int) -> str:
    parts = [f"SELECT doc_id, substr(t, i, {n}) AS term FROM (SELECT doc_id, t, unnest(range(1, CAST(length(t) AS BIGINT) - {n - 2})) AS i FROM sq WHERE length(t) >= {n})" for n in range(low, high + 1)]
    return r"sq AS (SELECT doc_id, regexp_replace(lower(text), '\s\s+', ' ', 'g') AS t FROM docs), grams AS (" + " UNION ALL ".join(parts) + ")"


def _weights(terms: str, limit: int, tf: str = "tf", bounds: str = "") -> str:
    return f"""{_DOCS}, {terms}, counts AS (SELECT doc_id, term, count(*) AS tf FROM grams GROUP BY 1, 2),
    n AS (SELECT count(*) AS n FROM docs),
    vocab AS (SELECT term, count(*) AS df, sum(tf) AS ctf FROM counts GROUP BY term {bounds} ORDER BY ctf DESC, term LIMIT {limit}),
    raw AS (SELECT doc_id, term, {tf} * (ln((1.0::DOUBLE + n) / (1.0::DOUBLE + df)) + 1) AS w FROM counts JOIN vocab USING (term), n),
    weights AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM raw)"""


_WORD_SQL = _weights(_word_terms(2), 50_000)
_IMPROVED_SQL = _weights(_word_terms(3), 50_000, "(1 + ln(tf))", "HAVING count(*) >= 2 AND count(*) <= 0.95 * (SELECT n FROM n)")


def _six(df):
    return df.withColumn("weight", F.round("weight", 6))


@query("word_tfidf", f"WITH {_WORD_SQL} SELECT doc_id, term, round(weight, 6) AS weight FROM weights")
def word_tfidf(spark, sf):
    return _six(tfidf.tfidf(_conversations(spark, sf), "word"))


@query("char_tfidf", f"WITH {_weights(_char_terms(3, 5), 25_000)} SELECT doc_id, term, round(weight, 6) AS weight FROM weights")
def char_tfidf(spark, sf):
    return _six(tfidf.tfidf(_conversations(spark, sf), "char"))


@query("tfidf_improved", f"WITH {_IMPROVED_SQL} SELECT doc_id, term, round(weight, 6) AS weight FROM weights")
def tfidf_improved(spark, sf):
    return _six(tfidf.tfidf(_conversations(spark, sf), "word", tfidf.IMPROVED))


@query("vocab_topk", f"WITH {_WORD_SQL} SELECT term, CAST(df AS BIGINT) AS df, CAST(ctf AS BIGINT) AS ctf FROM vocab")
def vocab_topk(spark, sf):
    docs = _conversations(spark, sf)
    return tfidf.learnt(docs, "word").select("term", "df", "ctf")


@query("term_statistics", f"WITH {_DOCS}, {_word_terms(1)} SELECT term, CAST(count(DISTINCT doc_id) AS BIGINT) AS df, CAST(count(*) AS BIGINT) AS ctf FROM grams GROUP BY term")
def term_statistics(spark, sf):
    counts = tfidf.term_counts(_conversations(spark, sf), "word", tfidf.Settings(words=(1, 1)))
    return counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("ctf"))


@query(
    "feature_names",
    f"""WITH {_WORD_SQL} SELECT 'word' AS kind, term, 'word_' || term AS name FROM vocab
    UNION ALL SELECT * FROM (WITH {_weights(_char_terms(3, 5), 25_000)} SELECT 'char', term, 'char_' || term FROM vocab)""",
)
def feature_names(spark, sf):
    docs = _conversations(spark, sf)
    n = docs.count()
    return tfidf.feature_names(*[tfidf.learnt(docs, kind, n_docs=n) for kind in ("word", "char")])


@query(
    "top_terms_per_doc",
    f"""WITH {_WORD_SQL}, r AS (SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY round(weight, 9) DESC, term) AS r FROM weights)
    SELECT doc_id, string_agg(term, '|' ORDER BY r DESC) AS terms FROM r WHERE r <= 10 GROUP BY doc_id""",
)
def top_terms_per_doc(spark, sf):
    weights = tfidf.tfidf(_conversations(spark, sf), "word")
    return tfidf.top_terms(weights).select("doc_id", F.array_join("terms", "|").alias("terms"))


@query(
    "chi2_select",
    f"""WITH {_WORD_SQL}, y AS (SELECT doc_id, role AS label FROM docs), p AS (SELECT label, count(*)::DOUBLE / sum(count(*)) OVER () AS p FROM y GROUP BY label),
    o AS (SELECT term, label, sum(weight) AS o FROM weights JOIN y USING (doc_id) GROUP BY 1, 2), t AS (SELECT term, sum(o) AS total FROM o GROUP BY term)
    SELECT term, round(sum((coalesce(o, 0) - total * p) * (coalesce(o, 0) - total * p) / (total * p)), 5) AS chi2 FROM t CROSS JOIN p LEFT JOIN o USING (term, label) GROUP BY term""",
)
def chi2_select(spark, sf):
    docs = _conversations(spark, sf)
    weights = tfidf.tfidf(docs, "word")
    return tfidf.chi2(weights, docs.select("doc_id", F.col("role").alias("label"))).withColumn("chi2", F.round("chi2", 5))


_TOP_SQL = f"""WITH {_WORD_SQL}, y AS (SELECT doc_id, role AS label FROM docs), p AS (SELECT label, count(*)::DOUBLE / sum(count(*)) OVER () AS p FROM y GROUP BY label),
    o AS (SELECT term, label, sum(weight) AS o FROM weights JOIN y USING (doc_id) GROUP BY 1, 2), t AS (SELECT term, sum(o) AS total FROM o GROUP BY term),
    c AS (SELECT term, round(sum((coalesce(o, 0) - total * p) * (coalesce(o, 0) - total * p) / (total * p)), 6) AS s FROM t CROSS JOIN p LEFT JOIN o USING (term, label) GROUP BY term),
    best AS (SELECT term FROM c ORDER BY s DESC, term LIMIT 10000)
    SELECT doc_id, term, round(weight, 6) AS weight FROM weights SEMI JOIN best USING (term)"""


@query("chi2_top_k", _TOP_SQL)
def chi2_top_k(spark, sf):
    docs = _conversations(spark, sf)
    best = tfidf.chi2_top(tfidf.tfidf(docs, "word"), docs.select("doc_id", F.col("role").alias("label")), 10_000, digits=6)
    return _six(best).select("doc_id", "term", "weight")


@query("tfidf_improved_chars", f"WITH {_weights(_char_terms(3, 6), 25_000, '(1 + ln(tf))', 'HAVING count(*) >= 2 AND count(*) <= 0.95 * (SELECT n FROM n)')} SELECT doc_id, term, round(weight, 6) AS weight FROM weights")
def tfidf_improved_chars(spark, sf):
    return _six(tfidf.tfidf(_conversations(spark, sf), "char", tfidf.IMPROVED))


# ---- scaling ----
_SCALED = ["count_trust", "intensity_joy", "question_count", "count_surprise"]


@query(
    "scale_no_center",
    f"WITH f AS ({_features_sql(False)}) SELECT doc_id, "
    + ", ".join(f"round({c} / (SELECT CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END FROM f), 6) AS {c}" for c in _SCALED)
    + " FROM f",
)
def scale_no_center(spark, sf):
    out = scaling.standardised(lexicon_features(spark, sf).select("doc_id", *_SCALED), _SCALED)
    return out.select("doc_id", *[F.round(c, 6).alias(c) for c in _SCALED])


@query(
    "scale_center_clip",
    f"WITH f AS ({_features_sql(False)}), s AS (SELECT "
    + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in _SCALED)
    + " FROM f) SELECT doc_id, "
    + ", ".join(f"round(CASE WHEN s_{c} <= 1e-10 THEN 0.0 ELSE greatest(least(({c} - m_{c}) / s_{c}, 10.0), -10.0) END::DOUBLE, 6) AS {c}" for c in _SCALED)
    + " FROM f, s",
)
def scale_center_clip(spark, sf):
    out = scaling.standardised(lexicon_features(spark, sf).select("doc_id", *_SCALED), _SCALED, center=True, clip=10.0, least=1e-10)
    # -0.0 and 0.0 are one value
    return out.select("doc_id", *[(F.round(c, 6) + 0.0).alias(c) for c in _SCALED])


# ---- models: rows only, as no other engine fits them ----
def _kept(df):
    """``df`` as a written table, which goes with the application: fits read it again and again, and what they give is lazy."""
    from ..sources import store

    spark = df.sparkSession
    path = f"{store.session_folder(spark)}/rows"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _gold(spark, sf):
    """doc_id, label and lexicon features; texts are looked at once and end here."""
    docs = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("label"))
    return _kept(docs.join(lexicon_features(spark, sf), "doc_id"))


def _fit_predict(train, test, estimator, names):
    return models.predictions(estimator.fit(train).transform(test), names, ["doc_id", "label"])


def _coded(df):
    fitted = models.indexer().fit(df)
    return fitted.transform(df), list(fitted.labels)


def _parts(df):
    split = ranks.stratified_split(df.select("doc_id", "label"), "label", "doc_id").select("doc_id", "split")
    whole = df.join(split, "doc_id")
    return [whole.where(F.col("split") == s) for s in ("train", "val", "test")]


@query("train_lexicon_lr")
def train_lexicon_lr(spark, sf):
    df, names = _coded(_gold(spark, sf))
    train, _, test = _parts(df)
    fitted = scaling.fit(train, list(emotions.FEATURES))
    ready = lambda x: models.assembled(scaling.scaled(x, fitted, True, 10.0, 1e-10), list(emotions.FEATURES))
    return _fit_predict(ready(models.weighted(train)), ready(test), models.logistic(), names)


@query("train_tfidf_lr")
def train_tfidf_lr(spark, sf):
    # Rows are split as texts, which become vectors at once: their terms are many times as large.
    df, names = _coded(_conversations(spark, sf).withColumnRenamed("role", "label"))
    train, _, test = map(models.spread, _parts(df))
    learning = _kept(train.select("doc_id", "label", "code", "text"))
    fitted = models.learnt_tfidf(learning)
    vectors = models.with_tfidf(models.spread(learning), fitted).select("doc_id", "label", "code", "tfidf")
    held = models.with_tfidf(test.select("doc_id", "label", "text"), fitted)
    return _fit_predict(_kept(models.weighted(vectors)), held, models.logistic(features="tfidf"), names)


@query("model_selection")
def model_selection(spark, sf):
    df, _ = _coded(_gold(spark, sf))
    train, val, _ = _parts(df)
    fitted = scaling.fit(train, list(emotions.FEATURES))
    ready = lambda x: models.assembled(scaling.scaled(x, fitted, True, 10.0, 1e-10), list(emotions.FEATURES)).cache()
    # Read by every fit: 24 numbers a document.
    learnt, held = ready(models.weighted(train)), ready(val)
    try:
        best, _, scores = models.select_best(models.candidates(len(emotions.FEATURES)), learnt, held)
    finally:
        learnt.unpersist()
        held.unpersist()
    return spark.createDataFrame([(k, v, k == best) for k, v in scores.items()], "kind string, macro_f1 double, chosen boolean")


@query("embedding_hybrid")
def embedding_hybrid(spark, sf):
    """TF-IDF, embedding and scaled lexicon features side by side, for the documents that have an embedding."""
    from ..operators import service

    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang", F.col("lang").alias("label")).join(vectors, "doc_id")
    model, names, _ = service.train(docs, "hybrid", lexicon(spark), cues=CUES)
    scored = service.scored(model, models.embedding_vector(docs), "hybrid", lexicon(spark), None, CUES)
    return models.predictions(scored, names, ["doc_id", "label"])


@query("improved_training")
def improved_training(spark, sf):
    """Every turn's role as told by the best of LR, squared-hinge SVM and forest over improved TF-IDF."""
    from ..operators import service, tfidf

    turns = _conversations(spark, sf).withColumnRenamed("role", "label")
    model, names, note = service.train_improved(turns)
    scored = service.scored(model, models.spread(turns), "ml", None, settings=tfidf.IMPROVED)
    return models.predictions(scored, names, ["doc_id", "label"]).withColumn("algorithm", F.lit(note["algorithm"]))


@query(
    "embedding_pool",
    """SELECT label, CAST(i - 1 AS INTEGER) AS pos, round(avg(embedding[i]::DOUBLE), 5) AS mean
    FROM (SELECT label, embedding, unnest(range(1, 65)) AS i FROM embeddings) GROUP BY 1, 2""",
)
def embedding_pool(spark, sf):
    return models.mean_pooled(table(spark, sf, "embeddings"), "label").withColumn("mean", F.round("mean", 5))


@query("saved_evaluation")
def saved_evaluation(spark, sf):
    """Samples of the errors of a saved lexicon model that tells languages apart, evaluated as it was saved."""
    from ..operators import service
    from ..sources import sinks, store

    docs = table(spark, sf, "documents").select("doc_id", "text", "lang", F.col("lang").alias("label"))
    root = store.session_folder(spark)
    # Texts become features once, for the training and for what the saved model says.
    features = _kept(service.ready(docs, "lexicon", lexicon(spark), None, CUES, keep=("doc_id", "label")))
    service.train(features, "lexicon", lexicon(spark), f"{root}/model", cues=CUES)
    registry = sinks.Registry(spark, {("en", "lexicon"): f"{root}/model"})
    found, samples = service.evaluate_bundle(registry, docs, "en", "lexicon", lexicon(spark), f"{root}/evaluated", CUES, features)
    return samples.select("doc_id", "label", "prediction", "categories", *emotions.FEATURE_ORDER).withColumn("accuracy", F.lit(found["accuracy"]))


@query(
    "padded_pool",
    """WITH vectors AS (SELECT doc_id, list_transform(string_split(coalesce(text, ''), ' '), lambda w: [length(w), length(w) % 7, ascii(w)]) AS v FROM documents),
    numbered AS (SELECT doc_id, v, (row_number() OVER (ORDER BY doc_id) - 1) // 8 + 1 AS batch FROM vectors),
    most AS (SELECT batch, max(len(v)) AS padded FROM numbered GROUP BY batch)
    SELECT doc_id, batch, padded, CAST(i AS INTEGER) AS pos, round(list_sum(list_transform(v, lambda x: x[i + 1]::DOUBLE)) / padded, 6) AS mean
    FROM numbered JOIN most USING (batch), (SELECT unnest(range(0, 3)) AS i)""",
)
def padded_pool(spark, sf):
    """Means over each document's word vectors (length, length modulo 7, first code point), of eight documents to a padded batch."""
    vector = lambda w: F.array(F.length(w), F.length(w) % 7, F.ascii(w))
    docs = table(spark, sf, "documents").select("doc_id", F.transform(F.split(T.plain(F.col("text")), " "), vector).alias("tokens"))
    return models.padded_pooled(docs, "doc_id", size=8).withColumn("mean", F.round("mean", 6))


# ---- inference: predictions made from hashes, in either engine ----
_FOUR = ("joy", "sadness", "neutral", "disgust")


def _predicted(spark, sf):
    """doc_id, text, label (gold), prediction and probabilities over four classes."""
    digit = lambda i: F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), i, 2), 16, 10).cast("int")
    names = F.array(*map(F.lit, _FOUR))
    docs = table(spark, sf, "documents").select(
        "doc_id", "text",
        F.get(names, digit(1) % 4).alias("label"),
        F.when(digit(3) < 160, F.get(names, digit(1) % 4)).otherwise(F.get(names, digit(5) % 4)).alias("prediction"),
        *[(digit(2 * i + 7) / 256.0).alias(f"x{i}") for i in range(4)],
    )
    return docs.withColumn("probabilities", F.map_from_arrays(names, T.softmax(F.array("x0", "x1", "x2", "x3"))))


def _digit(i: int) -> str:
    return f"('0x' || substr(md5(CAST(doc_id AS VARCHAR)), {i}, 2))::INTEGER"


_NAMES4 = "['joy', 'sadness', 'neutral', 'disgust']"
_PREDICTED = f"""p0 AS (SELECT doc_id, text, {_NAMES4}[{_digit(1)} % 4 + 1] AS label,
  CASE WHEN {_digit(3)} < 160 THEN {_NAMES4}[{_digit(1)} % 4 + 1] ELSE {_NAMES4}[{_digit(5)} % 4 + 1] END AS prediction,
  {', '.join(f'exp({_digit(2 * i + 7)} / 256.0::DOUBLE) AS e{i}' for i in range(4))} FROM documents),
p AS (SELECT doc_id, text, label, prediction, {', '.join(f'e{i} / (e0 + e1 + e2 + e3) AS {n}' for i, n in enumerate(_FOUR))} FROM p0)"""


@query("softmax_scores", f"WITH {_PREDICTED} SELECT doc_id, {', '.join(f'round({n}, 6) AS {n}' for n in _FOUR)} FROM p")
def softmax_scores(spark, sf):
    p = _predicted(spark, sf)
    return p.select("doc_id", *[F.round(F.try_element_at("probabilities", F.lit(n)), 6).alias(n) for n in _FOUR])


@query("sigmoid_scores", "SELECT event_id, round(1 - 1 / (1 + exp(-value / 100)), 6) AS p0, round(1 / (1 + exp(-value / 100)), 6) AS p1 FROM events")
def sigmoid_scores(spark, sf):
    p = table(spark, sf, "events").select("event_id", T.two_class(F.col("value") / 100).alias("p"))
    return p.select("event_id", *[F.round(F.col("p")[i], 6).alias(f"p{i}") for i in (0, 1)])


_PLAIN_NEG = r"""lowtok AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS t FROM documents),
hasneg AS (SELECT doc_id, len(list_filter(t[1:len(t) - 1], lambda x: x IN ('not', 'never', 'no', 'cannot', 'by', 'of', 'de', 'der'))) > 0 AS neg FROM lowtok)"""
_FLIPPED = f"""{_PREDICTED}, {_PLAIN_NEG}, inv(prediction, inverse) AS ({values(INVERSE.items())}),
f AS (SELECT p.*, CASE WHEN neg AND prediction <> 'neutral' THEN inverse ELSE prediction END AS final, neg AND prediction IN ('joy', 'sadness') AS swap
  FROM p JOIN hasneg USING (doc_id) JOIN inv USING (prediction)),
g AS (SELECT doc_id, label, final, CASE WHEN swap THEN sadness ELSE joy END AS joy, CASE WHEN swap THEN joy ELSE sadness END AS sadness, neutral, disgust FROM f)"""


@query("negation_flip", f"WITH {_FLIPPED} SELECT doc_id, final AS prediction, round(joy, 6) AS joy, round(sadness, 6) AS sadness FROM g")
def negation_flip(spark, sf):
    out = predict.with_flip(_predicted(spark, sf), CUES)
    return out.select("doc_id", "prediction", *[F.round(F.try_element_at("probabilities", F.lit(n)), 6).alias(n) for n in ("joy", "sadness")])


@query(
    "confidence",
    f"""WITH {_FLIPPED} SELECT doc_id, round(CASE final WHEN 'joy' THEN joy WHEN 'sadness' THEN sadness WHEN 'neutral' THEN neutral WHEN 'disgust' THEN disgust ELSE 0.0 END::DOUBLE, 6) AS confidence FROM g""",
)
def confidence(spark, sf):
    return predict.with_flip(_predicted(spark, sf), CUES).select("doc_id", F.round("confidence", 6).alias("confidence"))


_LISTED = ", ".join(f"{{'k': '{n}', 'v': {n}}}" for n in _FOUR)


@query(
    "ranked_probabilities",
    f"""WITH {_PREDICTED}, u AS (SELECT doc_id, unnest([{_LISTED}]) AS e FROM p)
    SELECT doc_id, string_agg(e.k, '>' ORDER BY e.v DESC, e.k) AS ranking FROM u GROUP BY doc_id""",
)
def ranked_probabilities(spark, sf):
    return _predicted(spark, sf).select("doc_id", F.array_join(F.transform(T.ranked(F.col("probabilities")), lambda e: e["key"]), ">").alias("ranking"))


@query("predict_batch")
def predict_batch(spark, sf):
    from ..operators import service

    scored = train_lexicon_lr(spark, sf).join(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    done = service.finished(scored, "lexicon", len(emotions.FEATURES), CUES)
    return predict.display(done).select("doc_id", "prediction", "confidence", "percent", "few_words", "low_confidence")


_SERVED = (("lexicon", 24), ("lexicon", 21), ("hybrid", 24), ("hybrid", 21), ("ml", None))
_SERVED_SQL = " UNION ALL ".join(
    f"SELECT doc_id, '{kind}' AS model, CAST({width or 0} AS INTEGER) AS width, "
    + (
        "final AS prediction, round(joy, 6) AS joy, round(CASE final WHEN 'joy' THEN joy WHEN 'sadness' THEN sadness WHEN 'neutral' THEN neutral WHEN 'disgust' THEN disgust ELSE 0.0 END::DOUBLE, 6) AS confidence FROM g"
        if kind == "ml" or width == 21
        else "prediction, round(joy, 6) AS joy, round(CASE prediction WHEN 'joy' THEN joy WHEN 'sadness' THEN sadness WHEN 'neutral' THEN neutral ELSE disgust END, 6) AS confidence FROM p"
    )
    for kind, width in _SERVED
)


@query("serve_flip", f"WITH {_FLIPPED} {_SERVED_SQL}")
def serve_flip(spark, sf):
    """The same predictions as served by each kind and width of model: flipped only where the model doesn't see negation."""
    from functools import reduce

    from ..operators import service

    out = [
        service.finished(_predicted(spark, sf), kind, width, CUES).select(
            "doc_id", F.lit(kind).alias("model"), F.lit(width or 0).cast("int").alias("width"), "prediction",
            F.round(F.try_element_at("probabilities", F.lit("joy")), 6).alias("joy"), F.round("confidence", 6).alias("confidence"),
        )
        for kind, width in _SERVED
    ]
    return reduce(lambda a, b: a.unionByName(b), out)


# ---- evaluation ----
_PAIRS = f"{_PREDICTED}, pairs AS (SELECT label, prediction, count(*) AS n FROM p GROUP BY 1, 2)"
_CLASSES = f"""{_PAIRS}, cls AS (SELECT label AS c FROM pairs UNION SELECT prediction FROM pairs),
s AS (SELECT c, coalesce((SELECT sum(n) FROM pairs WHERE label = c), 0) AS support, coalesce((SELECT sum(n) FROM pairs WHERE prediction = c), 0) AS found,
  coalesce((SELECT sum(n) FROM pairs WHERE label = c AND prediction = c), 0) AS hit FROM cls),
pr AS (SELECT c, support, CASE WHEN found = 0 THEN 0.0 ELSE hit::DOUBLE / found END AS precision, CASE WHEN support = 0 THEN 0.0 ELSE hit::DOUBLE / support END AS recall FROM s),
per AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM pr)"""


def _pairs(spark, sf):
    return evaluate.pair_counts(_predicted(spark, sf))


@query("accuracy", f"WITH {_PREDICTED} SELECT round(avg(CASE WHEN label = prediction THEN 1.0::DOUBLE ELSE 0 END), 9) AS accuracy FROM p")
def accuracy(spark, sf):
    return evaluate.accuracy(_pairs(spark, sf)).select(F.round("accuracy", 9).alias("accuracy"))


@query("per_class_prf", f"WITH {_CLASSES} SELECT c AS label, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, CAST(support AS BIGINT) AS support FROM per")
def per_class_prf(spark, sf):
    return evaluate.per_class(_pairs(spark, sf)).select("label", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")], "support")


_AVERAGES = ("precision", "recall", "f1")


@query(
    "macro_weighted",
    f"WITH {_CLASSES} SELECT {', '.join(f'round(avg({c}), 9) AS macro_{c}' for c in _AVERAGES)}, {', '.join(f'round(sum({c} * support) / sum(support), 9) AS weighted_{c}' for c in _AVERAGES)} FROM per",
)
def macro_weighted(spark, sf):
    out = evaluate.averages(evaluate.per_class(_pairs(spark, sf)))
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])


_GRID = f"{_PAIRS}, cls AS (SELECT label AS c FROM pairs UNION SELECT prediction FROM pairs), grid AS (SELECT a.c AS label, b.c AS prediction, coalesce(n, 0) AS n FROM cls a CROSS JOIN cls b LEFT JOIN pairs ON label = a.c AND prediction = b.c)"


@query("confusion_matrix", f"WITH {_GRID} SELECT label, prediction, CAST(n AS BIGINT) AS n FROM grid")
def confusion_matrix(spark, sf):
    return evaluate.confusion(_pairs(spark, sf)).select("label", "prediction", "n")


@query("confusion_normalized", f"WITH {_GRID} SELECT label, prediction, round(n::DOUBLE / nullif(sum(n) OVER (PARTITION BY label), 0), 9) AS share FROM grid")
def confusion_normalized(spark, sf):
    return evaluate.confusion(_pairs(spark, sf)).select("label", "prediction", F.round("share", 9).alias("share"))


def _any(words) -> str:
    return " OR ".join(f"contains(lower(text), '{w}')" for w in words)


_EMOJI = "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in EMOJI_RANGES) + "]"


@query(
    "error_categories",
    rf"""SELECT doc_id, ({_any(ERROR_NEGATIONS)}) AS has_negation, regexp_matches(text, '{_EMOJI}') AS has_emoji,
      len(regexp_extract_all(text, '\S+')) < 5 AS is_short, ({_any(SARCASM_MARKS)}) AS has_sarcasm FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)""",
)
def error_categories(spark, sf):
    return table(spark, sf, "documents").select("doc_id", *[c.alias(k) for k, c in evaluate.error_categories(F.col("text")).items()])


@query("first_errors", f"WITH {_PREDICTED} SELECT doc_id, label, prediction FROM p WHERE label <> prediction ORDER BY doc_id LIMIT 50")
def first_errors(spark, sf):
    return evaluate.first_errors(_predicted(spark, sf)).select("doc_id", "label", "prediction")


@query("error_samples")
def error_samples(spark, sf):
    errors = evaluate.first_errors(_predicted(spark, sf)).select("doc_id", "text", "label", "prediction")
    ready = errors.select("doc_id", T.tokens(F.lower(T.plain(F.col("text")))).alias("tokens"), F.array().cast("array<boolean>").alias("flags"))
    scores = emotions.emotion_scores(emotions.hits(ready, lexicon(spark), "doc_id"), "doc_id")
    top = tfidf.top_terms(tfidf.tfidf(errors, "word", tfidf.Settings(), table(spark, sf, "documents")))
    return evaluate.error_samples(errors, top, scores)


_KINDS = ["lexicon", "ml", "hybrid"]


_MODEL_SQL = f"""{_PREDICTED}, r AS (SELECT d.lang, ['lexicon', 'ml'][{_digit(13)} % 2 + 1] AS model, p.label, p.prediction FROM p JOIN documents d USING (doc_id)),
q AS (SELECT lang, model, label, prediction, count(*) AS n FROM r GROUP BY ALL),
k AS (SELECT DISTINCT lang, model, label AS c FROM q UNION SELECT DISTINCT lang, model, prediction FROM q),
s AS (SELECT k.lang, k.model, c, coalesce(sum(n) FILTER (WHERE label = c), 0) AS support, coalesce(sum(n) FILTER (WHERE prediction = c), 0) AS found,
  coalesce(sum(n) FILTER (WHERE label = c AND prediction = c), 0) AS hit FROM k JOIN q ON k.lang = q.lang AND k.model = q.model GROUP BY 1, 2, 3),
f AS (SELECT *, CASE WHEN support + found = 0 THEN 0.0 ELSE 2.0::DOUBLE * hit / (support + found) END AS f1 FROM s),
m AS (SELECT lang, model, sum(hit)::DOUBLE / sum(support) AS accuracy, avg(f1) AS macro_f1, sum(f1 * support) / sum(support) AS weighted_f1 FROM f GROUP BY 1, 2)"""
_METRICS = ("accuracy", "macro_f1", "weighted_f1")
_PIVOT_SQL = " UNION ALL ".join(
    f"SELECT '{x}' AS metric, lang, " + ", ".join(f"round(coalesce(max({x}) FILTER (WHERE model = '{k}'), 0.0), 9) AS {k}" for k in _KINDS) + " FROM m GROUP BY lang"
    for x in _METRICS
)


@query("comparison_pivot", f"WITH {_MODEL_SQL} {_PIVOT_SQL}")
def comparison_pivot(spark, sf):
    """Accuracy, macro-F1 and weighted F1 of two models, by language; the third model has no results."""
    bit = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 13, 2), 16, 10).cast("int") % 2
    rows = _predicted(spark, sf).join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    rows = rows.withColumn("model", F.when(bit == 0, "lexicon").otherwise("ml"))
    return evaluate.comparisons(evaluate.by_group(rows, "lang", "model"), _KINDS, _METRICS)


@query("priority_corpus", "SELECT text, CASE WHEN role = 'user' THEN 'joy' ELSE 'sadness' END AS label FROM conversations WHERE trim(text) <> ''")
def priority_corpus(spark, sf):
    raw = table(spark, sf, "conversations").select("text", (F.col("role") == "user").alias("Joy"), F.lit("tristețe").alias("label"))
    return corpora.priority_corpus(raw)


@query(
    "fine_corpus",
    f"WITH {_FINE_MAP}, c AS (SELECT text, {_FINE}[turn % 28 + 1] AS name FROM conversations) SELECT text, target AS label FROM c JOIN fine ON fine.label = name",
)
def fine_corpus(spark, sf):
    raw = table(spark, sf, "conversations").select("text", F.array((F.col("turn") % 28).cast("int"), F.lit(3)).alias("labels"))
    return corpora.fine_corpus(raw)


