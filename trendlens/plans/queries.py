"""One query per operator over the given tables: ``name → (spark, folder) → DataFrame``."""

from __future__ import annotations

import uuid
from zlib import crc32

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendlens.functions import answers, fixed, prompts
from trendlens.functions.text import has_keyword, joined_text, signature
from trendlens.functions.values import country_or, mapped, olympic_flag, replaced, sport_flag
from trendlens.operators import classifier, countreg, dedupe, evaluation, features, labelling, lookups
from trendlens.operators import metrics, ranking, rollup, sampling, windows
from trendlens.operators.events import event_bars, event_line, span
from trendlens.plans import candidates, models, panel, roundtrips, training
from trendlens.session import scratch_dir, settle, spread
from trendlens.sources import records, sinks, views
from trendlens.sources.views import CORPUS_TERMS, ORDER, REGION_CODES
from trendlens.streaming import incremental

DIGITS = 6
CORPUS_TEXT = ["title", "tags", "description", "channelTitle", "country_code"]


def _rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, DIGITS) for c in cols})


# ---- panel -----------------------------------------------------------------

def _panel(duplicates: bool, date_type: str, trim_by: str = "rows"):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return panel.create_panel(views.videos(spark, sf), ORDER, duplicates, date_type, trim_by)
    return run


def _base_panel(spark, sf):
    return panel.create_panel(views.videos(spark, sf), ORDER)


def _full(spark, sf):
    return panel.full_panel(_base_panel(spark, sf), views.medals(spark, sf), REGION_CODES)


def first_appearance(spark, sf):
    v = views.videos(spark, sf)
    dated = v.select("video_id", "country_code", F.col("publishedAt").cast("date").alias("date_clean"),
                     "predicted_label", *ORDER)
    return dedupe.first_appearance(dated, ORDER).select(
        "video_id", "country_code", "date_clean", "predicted_label", "l_orderkey", "l_linenumber"
    )


def panel_calendar(spark, sf):
    return _rounded(panel.with_calendar(_base_panel(spark, sf)), "sports_pct", "olympic_pct")


def event_windows(spark, sf):
    full = panel.with_events(_base_panel(spark, sf), views.medals(spark, sf))
    return full.select("country_code", "date_clean", *models.WINDOWS, "olympic_period",
                       "event_time_summer", "event_time_winter")


def medal_daily(spark, sf):
    return rollup.daily_medals(records.union_all(list(views.medals(spark, sf).values())))


def panel_with_medals(spark, sf):
    return _full(spark, sf).select(
        "country_code", "country_code_iso3", "date_clean", "videos", "gold", "silver", "bronze",
        "medal_count", "medal_score",
    )


def medal_lags(spark, sf):
    lagged = windows.with_lags(_full(spark, sf))
    return lagged.select("country_code", "date_clean", "medal_count", *[f"medal_count_lag{n}" for n in range(1, 8)])


def medal_rolling(spark, sf):
    rolled = windows.with_rolling_sums(_full(spark, sf))
    return rolled.select("country_code", "date_clean", *[f"rolling_medals_{t}" for t in range(1, 22)])


def rolling_nulls(spark, sf):
    rolled = windows.with_rolling_sums(_full(spark, sf))
    return rollup.null_counts(rolled, [f"rolling_medals_{t}" for t in range(1, 22)])


def dense_rolling(spark, sf):
    """Lags and rolling sums on a panel without gaps: events per type and day."""
    daily = views.table(spark, sf, "events").groupBy(
        F.col("event_type").alias("country_code"), F.col("ts").cast("date").alias("date_clean")
    ).agg(F.count(F.lit(1)).alias("n"))
    lagged = windows.with_lags(daily, "n", 7)
    return windows.with_rolling_sums(lagged, "n", range(1, 22), "rolling_n")


def _event(kind: str):
    def studied(spark, sf):
        """The full panel and the event's bounds, whose medals are read from the tables once."""
        medals = views.medals(spark, sf)
        medals[kind] = settle(medals[kind])
        return panel.full_panel(_base_panel(spark, sf), medals, REGION_CODES), span(medals[kind])

    def line(spark, sf):
        full, bounds = studied(spark, sf)
        return _rounded(event_line(full, bounds, f"event_time_{kind}"), "sports_pct")

    def bars(spark, sf):
        full, bounds = studied(spark, sf)
        return _rounded(event_bars(full, bounds, f"event_time_{kind}"), "sports_pct", "centre")
    return line, bars


def country_effect_size(spark, sf):
    return _rounded(rollup.country_sizes(_full(spark, sf)), "videos", "sports_videos", "sports_pct")


def overdispersion(spark, sf):
    return _rounded(rollup.dispersion(_base_panel(spark, sf)), "variance", "mean")


def share_by_country_day(spark, sf):
    calendar = panel.with_calendar(_base_panel(spark, sf))
    return _rounded(calendar.select("country_code", "date_clean", "sports_pct", "olympic_pct"),
                    "sports_pct", "olympic_pct")


def medals_by_country_day(spark, sf):
    return _full(spark, sf).select("country_code_iso3", "date_clean", "medal_count")


# ---- counts and values -------------------------------------------------------

def label_shares(spark, sf):
    return _rounded(rollup.value_counts(views.videos(spark, sf), "predicted_label"), "share")


def country_counts(spark, sf):
    return rollup.value_counts(views.videos(spark, sf, "n_name"), "country_code").drop("share")


def distinct_counts(spark, sf):
    return rollup.record_counts(views.videos(spark, sf))


def distinct_countries(spark, sf):
    return views.videos(spark, sf, "n_name").select("country_code").distinct()


def distinct_pairs(spark, sf):
    return views.videos(spark, sf).select("country_code", "video_id").distinct()


def label_flags(spark, sf):
    v = views.videos(spark, sf)
    return v.groupBy(sport_flag().alias("sports"), olympic_flag().alias("olympic")).agg(F.count(F.lit(1)).alias("n"))


def country_codes(spark, sf):
    """Mapped, replaced and defaulted country codes of every customer."""
    places = views.places(spark, sf)
    return places.select(
        "c_custkey",
        mapped("r_name", {k: v for k, v in REGION_CODES.items() if k != "ASIA"}).alias("mapped"),
        replaced("r_name", {"MIDDLE EAST": "RUS"}).alias("replaced"),
    ).withColumn("filled", country_or("mapped"))


def signatures(spark, sf):
    return views.corpus(spark, sf).select("doc_id", signature().alias("sig"))


# ---- candidates, lookups, samples --------------------------------------------

def _candidates(spark, sf):
    return candidates.keyword_candidates(views.corpus(spark, sf), CORPUS_TERMS)


def keyword_candidates(spark, sf):
    return _candidates(spark, sf).select("doc_id", "title", "channelTitle", "country_code")


def sport_pages(spark, sf):
    """The full multilingual term list over whole pages."""
    found = candidates.keyword_candidates(views.table(spark, sf, "pages"), fixed.SPORT_TERMS, ["url", "html"])
    return found.select("page_id", "url")


def games_pages(spark, sf):
    """Both fixed lists over whole documents, as they are and with terms put in, and pages, matches counted per table."""
    docs = spread(views.table(spark, sf, "documents", "text")).select(F.lit("documents").alias("tab"), "text")
    docs = docs.unionByName(views.termed(spark, sf).select(F.lit("termed").alias("tab"), "text"))
    pages = spread(views.table(spark, sf, "pages", "html")).select(F.lit("pages").alias("tab"), F.col("html").alias("text"))
    flagged = docs.unionByName(pages).select(
        "tab", has_keyword(F.col("text"), fixed.GAMES_STEMS).alias("games"),
        has_keyword(F.col("text"), fixed.SPORT_TERMS).alias("sport"),
    )
    return flagged.groupBy("tab").agg(
        F.count(F.lit(1)).alias("scanned"), F.sum(F.col("games").cast("int")).alias("games"),
        F.sum(F.col("sport").cast("int")).alias("sport"),
    )


def sport_documents(spark, sf):
    """The full multilingual term list over documents, half of which have a term."""
    return candidates.keyword_candidates(views.termed(spark, sf), fixed.SPORT_TERMS, ["text"]).select("doc_id", "lang")


def capped_candidates(spark, sf):
    found = candidates.capped_candidates(
        views.corpus(spark, sf), ["doc_id"], ["doc_id"], CORPUS_TERMS, ["title", "tags", "description"],
        per_country=60, overall=150,
    )
    return found.select("doc_id", "country_code")


def first_per_country(spark, sf):
    v = views.videos(spark, sf, "n_name")
    return ranking.take_first(v, ["country_code"], ORDER, 200).select("country_code", *ORDER[:5])


def country_lookup(spark, sf):
    """First country of each part among all records, default for parts without one."""
    return lookups.lookup_country(views.candidate_parts(spark, sf), views.known_parts(spark, sf), ORDER)


def country_lookup_fallback(spark, sf):
    """All documents are known. Every second record asks with an id that none has; its signature is known, but for every fourth."""
    docs = views.corpus(spark, sf)
    lost = docs.withColumns({
        "video_id": F.when(F.col("doc_id") % 2 == 1, F.concat(F.lit("lost-"), "video_id")).otherwise(F.col("video_id")),
        "title": F.when(F.col("doc_id") % 4 == 3, F.concat(F.lit("lost "), "title")).otherwise(F.col("title"))})
    return lookups.lookup_country_or_signature(lost, docs, ["doc_id"]).select("doc_id", "country_code")


def negatives_anti(spark, sf):
    docs = views.corpus(spark, sf)
    return lookups.exclude_signed(docs, _candidates(spark, sf)).select("doc_id", "country_code")


def sampled_pos(spark, sf):
    rows = settle(_candidates(spark, sf).select("doc_id", "country_code"))
    return sampling.sample_per_country(rows, ["doc_id"], 50).select("doc_id", "country_code")


def sampled_neg(spark, sf):
    taken = settle(_candidates(spark, sf).select("title", "channelTitle", "publish_time"))
    rest = lookups.exclude_signed(views.corpus(spark, sf), taken)
    return sampling.sample_per_country(rest, ["doc_id"], 50).select("doc_id", "country_code")


def sampled_rows(spark, sf):
    return sampling.sample_rows(views.corpus(spark, sf), ["doc_id"], 120, 7).select("doc_id", "country_code")


def shuffled_rows(spark, sf):
    """Positions in seeded random order, counted over all rows."""
    return ranking.rank_by_hash(views.corpus(spark, sf).select("doc_id"), [], ["doc_id"], 42, rank="position")


def upsampled_class(spark, sf):
    grown = sampling.resample_class(views.train(spark, sf), "label", "olympic", ["doc_id"], 400)
    return grown.select("doc_id", "label", "draw")


def downsampled_class(spark, sf):
    cut = sampling.resample_class(views.train(spark, sf), "label", "other_sport", ["doc_id"], 40)
    return cut.select("doc_id", "label", "draw")


def balanced_quota(spark, sf):
    taken = sampling.balanced_quota(views.corpus(spark, sf), ["doc_id"], 100)
    return taken.select("round", "country_code", "doc_id")


def stratified_split(spark, sf):
    return sampling.stratified_split(views.train(spark, sf), "label", ["doc_id"]).select("doc_id", "label", "is_test")


def shard(spark, sf):
    """Rows 30 … 129 of the labelled documents by position, whatever their ids."""
    rows = views.train(spark, sf).select("doc_id", "country_code")
    placed = ranking.with_position(rows, ["doc_id"], "ingest_seq")
    return records.shard(placed, 30, 100).select(F.col("ingest_seq").alias("index"), "doc_id", "country_code")


def labelled_union(spark, sf):
    """Union of three tables whose columns differ; the missing ones are null."""
    docs = views.corpus(spark, sf).select("doc_id", "country_code")
    labels = views.table(spark, sf, "labels")
    bench = views.table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"))
    return records.union_all([docs, labels, bench])


def preview(spark, sf):
    return candidates.preview(views.videos(spark, sf), ORDER, 25).select(*ORDER, "country_code")


def run_metrics(spark, sf):
    docs = views.corpus(spark, sf)
    return metrics.match_counts(docs, has_keyword(joined_text(CORPUS_TEXT), CORPUS_TERMS), "channelTitle")


# ---- prompts and answers -----------------------------------------------------

def prompts_built(spark, sf):
    return views.corpus(spark, sf).select(
        "doc_id", prompts.slot_prompt(tags="description").alias("slot_prompt"),
        prompts.line_prompt(tags="description").alias("line_prompt"),
    )


def parsed_json(spark, sf):
    return answers.with_json_answer(views.json_answers(spark, sf), "raw_resp").select("doc_id", "label", "reason")


def parsed_lines(spark, sf):
    return answers.with_line_answer(views.line_answers(spark, sf), "raw_resp").select("doc_id", "label", "reason")


def failed_answers(spark, sf):
    """Answers exist for labelled documents only; the others count as failed."""
    known = views.table(spark, sf, "labels").select("doc_id")
    raw = views.json_answers(spark, sf).join(known, "doc_id", "left_semi")
    rows = views.corpus(spark, sf).select("doc_id").join(raw, "doc_id", "left")
    return labelling.with_labels(rows).select("doc_id", "label", "reason")


def rule_labels(spark, sf):
    """The default rule labeller over whole documents, half of which have a listed term, answers parsed back."""
    docs = views.termed(spark, sf).withColumn("raw_resp", labelling.rule_answer(["text"]))
    return labelling.with_labels(docs).select("doc_id", "label", "reason")


def _stream_folder(spark, sf, job):
    return f"{scratch_dir(spark)}/{job}-{spark.sparkContext.applicationId}-{crc32(sf.encode())}"


def incremental_candidates(spark, sf):
    """The keyword filter on a file stream."""
    folder = _stream_folder(spark, sf, "candidates")
    rows = incremental.record_stream(spark, sf, "documents.parquet").select("doc_id", "text", "lang")
    found = incremental.keyword_stream(rows, ["text"], CORPUS_TERMS).select("doc_id", F.col("lang").alias("country_code"))
    incremental.run_once(found, f"{folder}/state", f"{folder}/out")
    return spark.read.parquet(f"{folder}/out").select("doc_id", "country_code")


def incremental_lookup(spark, sf):
    """A stream of line items joined with the static table of each part's first country."""
    folder = _stream_folder(spark, sf, "lookup")
    known = settle(lookups.first_seen(views.known_parts(spark, sf), "video_id", "country_code", ORDER))
    key = F.when(F.col("l_partkey") % 5 == 0, -F.col("l_partkey")).otherwise(F.col("l_partkey"))
    items = incremental.record_stream(spark, sf, "lineitem.parquet").select(key.alias("video_id"))
    step = incremental.lookup_step(known, "video_id", "country_code", fixed.NO_COUNTRY)
    incremental.run_once(items, f"{folder}/state", f"{folder}/out", step)
    return spark.read.parquet(f"{folder}/out").groupBy("country_code").agg(F.count(F.lit(1)).alias("n"))


def incremental_first_seen(spark, sf):
    """The language each title was first seen with, kept as the state of a stream of documents."""
    folder = _stream_folder(spark, sf, "first-seen")
    rows = incremental.record_stream(spark, sf, "documents.parquet").select(
        F.sha1(F.split_part("text", F.lit("\n"), F.lit(1))).alias("title_sha1"), "lang", "doc_id")
    changes = incremental.first_seen_updates(rows, "title_sha1", "lang", ["doc_id"])
    incremental.run_once(changes, f"{folder}/state", f"{folder}/out", mode="update")
    return incremental.first_seen_now(spark, f"{folder}/out", "title_sha1", "lang", ["doc_id"])


def incremental_label(spark, sf):
    """The same labels as a batch, from a file stream with a checkpoint."""
    folder = _stream_folder(spark, sf, "label")
    rows = incremental.record_stream(spark, sf, "documents.parquet")
    keyword = has_keyword(F.col("text"), CORPUS_TERMS)
    answer = F.concat(F.lit('{"label":"'), F.when(keyword, "other_sport").otherwise("non_sport"),
                      F.lit('","reason":"keyword rule"}'))
    asked = rows.select("doc_id", F.col("lang").alias("country_code"), answer.alias("raw_resp"))
    incremental.run_once(asked, f"{folder}/state", f"{folder}/out", labelling.with_labels)
    return spark.read.parquet(f"{folder}/out").select("doc_id", "country_code", "label", "reason")


# ---- features, classifiers, evaluation ----------------------------------------

def dedup_train(spark, sf):
    return training.training_rows(views.dirty_train(spark, sf), ["doc_id", "copy"]).select("doc_id", "label")


def _train_text(spark, sf):
    return views.train(spark, sf).withColumn("text", joined_text(["title", "tags", "description"]))


def token_counts(spark, sf):
    counts = features.term_counts(spread(views.table(spark, sf, "documents", "doc_id", "text")), "doc_id", "text", (1, 1))
    return counts.groupBy("doc_id").agg(F.sum("tf").alias("tokens"), F.count(F.lit(1)).alias("distinct_tokens"))


def ngram_vocab(spark, sf):
    rows = _train_text(spark, sf)
    counts = features.term_counts(rows, "doc_id", "text")
    return features.vocabulary(counts, rows.agg(F.count(F.lit(1))).scalar())


def tfidf_terms(spark, sf):
    return _rounded(features.tfidf(_train_text(spark, sf), "doc_id", "text"), "weight")


_fitted: dict[tuple, tuple] = {}


def _text_model(spark, sf, split_first=False):
    """One fit per session and table folder: the queries that show it share it."""
    key = (spark.sparkContext.applicationId, sf, split_first)
    if key not in _fitted:
        rows = _train_text(spark, sf).select("doc_id", "label", "text")
        features_, model, valid = training.train_text_classifier(rows, ["doc_id"], split_first=split_first)
        _fitted[key] = features_, model, settle(valid)
    return _fitted[key]


def classifier_fit(spark, sf):
    """Validation rows per class, whether the fit settled, and what is left of its gradient."""
    _, model, valid = _text_model(spark, sf)
    return valid.groupBy("label").agg(F.count(F.lit(1)).alias("n")).withColumns({
        "converged": F.lit(model.converged), "gradient": F.round(F.lit(model.gradient), DIGITS)})


def classifier_report(spark, sf):
    _, _, valid = _text_model(spark, sf)
    return evaluation.classification_report(valid, "label", "predicted_label")


def classifier_report_split_first(spark, sf):
    _, _, valid = _text_model(spark, sf, split_first=True)
    return evaluation.classification_report(valid, "label", "predicted_label")


def classifier_confusion(spark, sf):
    _, _, valid = _text_model(spark, sf)
    return evaluation.confusion(valid, "label", "predicted_label", fixed.LABELS)


def top_features(spark, sf):
    feats, model, _ = _text_model(spark, sf)
    return classifier.top_features(feats, model, "olympic", 40)


def scored_labels(spark, sf):
    """Every document labelled by a model trained on the labelled ones."""
    feats, model, _ = _text_model(spark, sf)
    path = f"{scratch_dir(spark)}/model-{uuid.uuid4().hex}"
    sinks.save_model(model, path)
    model = sinks.load_model(path)
    docs = views.corpus(spark, sf).withColumn("text", joined_text(["title", "tags", "description"]))
    return classifier.score(docs.select("doc_id", "text"), feats, model).select("doc_id", "predicted_label")


def embedding_classifier(spark, sf):
    rows = classifier.embedding_features(views.table(spark, sf, "embeddings"))
    parts = sampling.stratified_split(rows.withColumn("label", F.col("label").cast("string")), "label", ["vec_id"])
    model = classifier.fit_classifier(parts.filter(~F.col("is_test")))
    valid = classifier.score(parts.filter("is_test"), model)
    return evaluation.classification_report(valid, "label", "predicted_label")


def _fixed_predictions(spark, sf):
    """True label against a keyword rule."""
    rule = F.when(has_keyword(F.col("description"), CORPUS_TERMS), "olympic").when(
        F.col("country_code") == "en", "other_sport").otherwise("non_sport")
    return views.train(spark, sf).select("label", rule.alias("predicted_label"))


def report_fixed(spark, sf):
    report = evaluation.classification_report(_fixed_predictions(spark, sf), "label", "predicted_label")
    return _rounded(report, "precision", "recall", "f1")


def confusion_fixed(spark, sf):
    return evaluation.confusion(_fixed_predictions(spark, sf), "label", "predicted_label", fixed.LABELS)


# ---- count regression ----------------------------------------------------------

def nb_single_factor(spark, sf):
    """Sport videos per cell by country alone; the fit has a closed form."""
    table = countreg.fit_counts(_base_panel(spark, sf), "sports_videos",
                                {"country": [countreg.Category("country_code")]})
    return _rounded(table.select("term", "coef", "se_hc0", "se_hc3"), "coef", "se_hc0", "se_hc3")


def nb_records(spark, sf):
    """Quantity of all line items by country: the rows are folded to one cell per country and quantity's moments."""
    rows = views.videos(spark, sf).join(views.table(spark, sf, "lineitem", *ORDER, "l_quantity"), ORDER)
    table = countreg.fit_counts(rows, "l_quantity", {"country": [countreg.Category("country_code")]})
    return _rounded(table.select("term", "n", "coef", "se_hc0", "se_hc3"), "coef", "se_hc0", "se_hc3")


COEFFICIENTS = ["coef", "se_hc0", "se_hc3", "z", "p_value", "ci_low", "ci_high"]


def nb_coefficients(spark, sf):
    """Coefficient tables of all models: estimate, robust errors, z, p and the 95 % interval of every term."""
    table = models.fit(_full(spark, sf), *models.MODELS)
    return _rounded(table.select("model", "term", "n", *COEFFICIENTS, "dropped", "converged"), *COEFFICIENTS)


def nb_predictors(spark, sf):
    """Coefficient and error of the medal count and of the medal score, each in its own model."""
    return _rounded(models.compare_medals(_full(spark, sf)).select("model", "term", *COEFFICIENTS), *COEFFICIENTS)


def nb_rolling_z(spark, sf):
    """Coefficient and z of each rolling window of medals."""
    return _rounded(models.rolling_sweep(_full(spark, sf)).select("rolling_window", "coef", "z_value"), "coef", "z_value")


def _nb(*names: str):
    def run(spark, sf):
        return models.settled(models.fit(_full(spark, sf), *names))
    return run


def nb_medal_compare(spark, sf):
    return models.settled(models.compare_medals(_full(spark, sf)))


def nb_rolling_sweep(spark, sf):
    return models.rolling_sweep(_full(spark, sf)).select(
        "rolling_window", "n", "converged", F.round("score", DIGITS).alias("score"))


_summer_line, _summer_bars = _event("summer")
_winter_line, _winter_bars = _event("winter")

QUERIES = {
    "panel_published_nodup": _panel(False, "published"),
    "panel_published_dup": _panel(True, "published"),
    "panel_trending_nodup": _panel(False, "trending"),
    "panel_trending_dup": _panel(True, "trending"),
    "panel_trending_trim_days": _panel(False, "trending", "days"),
    "first_appearance": first_appearance,
    "panel_calendar": panel_calendar,
    "event_windows": event_windows,
    "medal_daily": medal_daily,
    "panel_with_medals": panel_with_medals,
    "medal_lags": medal_lags,
    "medal_rolling": medal_rolling,
    "rolling_nulls": rolling_nulls,
    "dense_rolling": dense_rolling,
    "event_study_line_summer": _summer_line,
    "event_study_line_winter": _winter_line,
    "event_study_bars_summer": _summer_bars,
    "event_study_bars_winter": _winter_bars,
    "country_effect_size": country_effect_size,
    "overdispersion": overdispersion,
    "share_by_country_day": share_by_country_day,
    "medals_by_country_day": medals_by_country_day,
    "label_shares": label_shares,
    "country_counts": country_counts,
    "distinct_counts": distinct_counts,
    "distinct_countries": distinct_countries,
    "distinct_pairs": distinct_pairs,
    "label_flags": label_flags,
    "country_codes": country_codes,
    "signatures": signatures,
    "keyword_candidates": keyword_candidates,
    "sport_pages": sport_pages,
    "games_pages": games_pages,
    "sport_documents": sport_documents,
    "capped_candidates": capped_candidates,
    "first_per_country": first_per_country,
    "country_lookup": country_lookup,
    "country_lookup_fallback": country_lookup_fallback,
    "negatives_anti": negatives_anti,
    "sampled_pos": sampled_pos,
    "sampled_neg": sampled_neg,
    "sampled_rows": sampled_rows,
    "shuffled_rows": shuffled_rows,
    "upsampled_class": upsampled_class,
    "downsampled_class": downsampled_class,
    "balanced_quota": balanced_quota,
    "stratified_split": stratified_split,
    "shard": shard,
    "labelled_union": labelled_union,
    "preview": preview,
    "run_metrics": run_metrics,
    "prompts": prompts_built,
    "parsed_json": parsed_json,
    "parsed_lines": parsed_lines,
    "failed_answers": failed_answers,
    "rule_labels": rule_labels,
    "incremental_label": incremental_label,
    "incremental_candidates": incremental_candidates,
    "incremental_lookup": incremental_lookup,
    "incremental_first_seen": incremental_first_seen,
    "dedup_train": dedup_train,
    "token_counts": token_counts,
    "ngram_vocab": ngram_vocab,
    "tfidf_terms": tfidf_terms,
    "classifier_fit": classifier_fit,
    "classifier_report": classifier_report,
    "classifier_report_split_first": classifier_report_split_first,
    "classifier_confusion": classifier_confusion,
    "top_features": top_features,
    "scored_labels": scored_labels,
    "embedding_classifier": embedding_classifier,
    "report_fixed": report_fixed,
    "confusion_fixed": confusion_fixed,
    "nb_single_factor": nb_single_factor,
    "nb_records": nb_records,
    "nb_coefficients": nb_coefficients,
    "nb_predictors": nb_predictors,
    "nb_rolling_z": nb_rolling_z,
    "nb_base": _nb("base"),
    "nb_trend": _nb("trend"),
    "nb_season": _nb("season"),
    "nb_hetero": _nb("hetero"),
    "nb_pre_post": _nb("pre_post"),
    "nb_medal_compare": nb_medal_compare,
    "nb_rolling_sweep": nb_rolling_sweep,
    **roundtrips.QUERIES,
}
