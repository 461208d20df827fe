"""The registered queries of the engine itself, over the driver's tables; their SQL is in ``oracles``.

The tables stand in for clinical ones: customers are patients, orders exams, line items attachments, events
observations and alerts, documents pages of a source, parts a catalog.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clinical, text
from ..operators import admissions, catalogs, chunking, embedding, history, incremental, intervals, records, rules, vectors, windows
from ..sources import web
from ..storage import cut, scratch, table_of
from ..streaming import alerts as streams
from ..streaming import ordered
from . import reference_data
from .oracles import SQL  # noqa: F401

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def digest(c: Column) -> Column:
    return F.sha2(c, 256)


# Retrieval.


def _neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=6)


@query
def knn_topk(spark, sf_dir):
    return _neighbours(spark, sf_dir).withColumn("distance", F.round("distance", 6))


@query
def citations(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "source")
    found = _neighbours(spark, sf_dir).join(docs, "vec_id", "left")
    return found.select("query_id", "rank", F.format_string("[%d] %s", "rank", clinical.citation(F.col("source"), F.col("vec_id"), F.lit(None))).alias("label"))


@query
def knn_sources(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "source")
    found = _neighbours(spark, sf_dir).join(docs, "vec_id", "left")
    return found.groupBy("query_id").agg(F.array_join(F.sort_array(F.collect_set("source")), ", ").alias("sources"))


# Filters and lookups.


@query
def latest_per_key(spark, sf_dir):
    last = windows.latest(table(spark, sf_dir, "events"), "user_id", "ts", "event_id")
    return last.select("user_id", "event_id", micros(F.col("ts")).alias("ts_us"), "event_type", "value")


@query
def patients_filter(spark, sf_dir):
    rows = records.where_truthy(table(spark, sf_dir, "customer"), "c_mktsegment", "BUILDING")
    return records.where_truthy(rows, "c_name", "").select("c_custkey", "c_name", "c_acctbal")


@query
def patients_search(spark, sf_dir):
    return records.matching(table(spark, sf_dir, "customer"), "1_5%", "c_name", "c_custkey").select("c_custkey", "c_name")


def _alerts(spark, sf_dir):
    team = F.element_at(F.array(*map(F.lit, ("all", "doctors", "nurses", "pharmacy"))), (F.col("user_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "events").withColumn("team", team)


@query
def alerts_filter(spark, sf_dir):
    rows = records.where_given(_alerts(spark, sf_dir), "event_type", "error")
    return records.for_team(rows, "doctors").select("event_id", "user_id", "team")


@query
def alerts_none(spark, sf_dir):
    return records.where_given(_alerts(spark, sf_dir), "event_type", "").select("event_id", "team")


@query
def patient_by_id(spark, sf_dir):
    return records.by_key(table(spark, sf_dir, "customer"), c_custkey=42).select("c_custkey", "c_name")


@query
def exam_by_key(spark, sf_dir):
    return records.by_key(table(spark, sf_dir, "orders"), o_custkey=899, o_orderkey=0).select("o_orderkey", "o_custkey", "o_orderstatus")


# Documents: duplicates, spans, chunks, text functions.


@query
def exact_dedup(spark, sf_dir):
    return incremental.exact_duplicates(table(spark, sf_dir, "documents"), "doc_id", F.coalesce("text", F.lit("")))


@query
def page_spans(spark, sf_dir):
    return chunking.page_spans(table(spark, sf_dir, "documents"), "source", "doc_id", "text")


@query
def clean_pages(spark, sf_dir):
    rows = text.with_clean(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", "clean")
    return rows.select("doc_id", digest(F.col("clean")).alias("clean_sha256"), F.length("clean").alias("n_chars"))


@query
def chunk_text(spark, sf_dir):
    return chunking.fixed_chunks(table(spark, sf_dir, "documents"), "doc_id", "text").withColumn("chunk", digest(F.col("chunk"))).withColumnsRenamed({"start": "char_start", "end": "char_end"})


@query
def chunk_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", chunking.n_chunks(F.length("text")).alias("n"))


@query
def chunk_page_range(spark, sf_dir):
    return chunking.chunk_page_ranges(page_spans(spark, sf_dir))


@query
def chunk_ids(spark, sf_dir):
    rows = chunking.fixed_chunks(table(spark, sf_dir, "documents"), "doc_id", "text")
    return rows.select("doc_id", "chunk_index", chunking.chunk_id(F.col("doc_id"), F.col("chunk_index")).alias("chunk_id"))


@query
def word_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.word_count(F.col("text")).alias("n"))


@query
def norm_space(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", digest(text.norm_space(F.col("text"))).alias("normal"))


@query
def ascii_fold(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", digest(text.ascii_fold(F.col("text"))).alias("folded"))


@query
def norm_key(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", digest(text.norm_key(F.col("text"))).alias("key"))


@query
def sanitize_name(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", digest(text.sanitize_name(F.col("text"))).alias("name"))


@query
def parse_lines(spark, sf_dir):
    lines = text.parse_lines(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(lines).alias("n"), digest(F.array_join(lines, "|")).alias("lines"))


# Pages.


@query
def page_links(spark, sf_dir):
    return web.page_links(table(spark, sf_dir, "pages"))


@query
def url_id(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.url_id(F.col("url")).alias("id"))


@query
def local_filename(spark, sf_dir):
    kind = F.element_at(F.array(F.lit("application/pdf"), F.lit("text/html"), F.lit("")), (F.col("page_id") % 3 + 1).cast("int"))
    rows = table(spark, sf_dir, "pages").select("page_id", text.local_filename(F.col("url"), kind).alias("name"), F.substring(F.sha2("url", 256), 1, 8).alias("sha8"))
    again = F.regexp_replace("name", r"(\.[^.]*)$", F.concat(F.lit("_"), "sha8", F.lit("$1")))
    named = windows.with_least(table_of(rows, "names"), "name", "page_id", "first")
    return named.select("page_id", F.when(F.col("page_id") == F.col("first"), F.col("name")).otherwise(again).alias("filename"))


# Records.


@query
def patient_detail(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    orders = table(spark, sf_dir, "orders").filter("o_totalprice > 100000").select("o_custkey", "o_orderkey", "o_orderstatus")
    children = records.nested(orders.withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "exams", F.col("o_orderkey"))
    last = windows.latest(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value"), "user_id", "ts", "event_id")
    vitals = last.select(F.col("user_id").alias("c_custkey"), F.col("value").alias("vital"))
    rows = records.with_children(customers, "c_custkey", children).join(vitals, "c_custkey", "left")
    shown = F.array_join(F.transform("exams", lambda e: F.concat_ws(":", e["o_orderkey"].cast("string"), e["o_orderstatus"])), ",")
    return rows.select("c_custkey", "c_name", F.coalesce("vital", F.lit(36.5)).alias("vital"), F.size("exams").alias("n_exams"), shown.alias("exams"))


@query
def exam_attachments(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", "l_quantity")
    children = records.nested(items, "o_orderkey", "files", F.col("l_linenumber"), F.col("l_partkey"), F.col("l_quantity"))
    rows = records.with_children(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", children)
    shown = F.array_join(F.transform("files", lambda f: F.concat_ws(":", f["l_linenumber"].cast("string"), f["l_partkey"].cast("string"))), ",")
    return rows.select("o_orderkey", F.size("files").alias("n"), shown.alias("files"))


@query
def alert_names(spark, sf_dir):
    people = table(spark, sf_dir, "customer").filter("c_custkey % 3 = 0").select("c_custkey", "c_name")
    rows = table(spark, sf_dir, "events").join(people, F.col("user_id") == F.col("c_custkey"), "left")
    return rows.select("event_id", F.when(F.col("user_id") == 0, "Sistema").otherwise(F.coalesce("c_name", F.col("user_id").cast("string"))).alias("name"))


@query
def pending_counts(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "P").alias("pending"))


@query
def unresolved_count(spark, sf_dir):
    return table(spark, sf_dir, "orders").filter("o_orderstatus != 'F'").agg(F.count("*").alias("unresolved"))


@query
def group_fixed_domain(spark, sf_dir):
    items = table(spark, sf_dir, "events").withColumnRenamed("event_type", "type")
    return records.fixed_groups(items, "type", ["view", "click", "prescription", "purchase"])


@query
def last_user_turn(spark, sf_dir):
    return records.last_user_turn(table(spark, sf_dir, "conversations"))


@query
def vitals_locf(spark, sf_dir):
    patches = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.when(F.col("event_type") == "view", F.col("value")).alias("temperature"), F.when(F.col("event_type") == "click", F.round("value").cast("int")).alias("heart_rate"))
    told = records.carry_forward(patches, "user_id", ["ts", "event_id"], {k: records.DEFAULT_VITALS[k] for k in ("temperature", "heart_rate")})
    return told.select("event_id", "temperature", "heart_rate")


@query
def patch_fold(spark, sf_dir):
    patches = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_type") == "view", F.col("value")).alias("a"), F.when(F.col("event_type") == "error", F.col("value")).alias("b"))
    return records.fold_patches(patches, "user_id", "event_id", ["a", "b"])


# Rules.


def _patches(spark, sf_dir):
    return _as_patches(table(spark, sf_dir, "events"))


def _as_patches(events):
    kind, value = F.col("event_type"), F.col("value")
    return events.select(
        "event_id",
        F.col("user_id").cast("string").alias("patient_id"),
        F.col("event_id").alias("recorded_at"),
        F.when(kind == "view", F.greatest(F.lit(0), 100 - F.floor(value / 5))).cast("int").alias("oxygen_saturation"),
        F.when(kind == "click", F.round(34 + value / 60, 1)).alias("temperature"),
        F.when(kind == "error", F.floor(40 + value / 2)).cast("int").alias("heart_rate"),
        F.when(kind == "purchase", F.concat(F.floor(10 + value / 3).cast("string"), F.lit("/80"))).alias("blood_pressure"),
    )


@query
def vital_alerts(spark, sf_dir):
    return rules.vital_alerts(_patches(spark, sf_dir))


@query
def stream_vital_alerts(spark, sf_dir):
    """The same alerts from a stream of the table's files."""
    schema = table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")
    out = scratch(spark, "alerts")
    streams.alert_stream(_as_patches(events), out, scratch(spark, "offsets")).awaitTermination()
    return spark.read.parquet(out)


@query
def vital_tiers(spark, sf_dir):
    p = _patches(spark, sf_dir)
    kind = F.when(F.col("oxygen_saturation").isNotNull(), "oxygen_saturation").when(F.col("temperature").isNotNull(), "temperature").when(F.col("heart_rate").isNotNull(), "heart_rate").when(F.col("blood_pressure").isNotNull(), "systolic")
    value = F.coalesce(F.col("oxygen_saturation").cast("double"), "temperature", F.col("heart_rate").cast("double"), clinical.systolic(F.col("blood_pressure")).cast("double"))
    return p.withColumns({"kind": kind, "v": value}).filter("kind is not null").select("event_id", "kind", clinical.vital_tier(F.col("kind"), F.col("v")).alias("tier"))


@query
def systolic(spark, sf_dir):
    shown = F.concat(F.floor(F.col("o_totalprice") / 2500).cast("string"), F.when(F.col("o_orderkey") % 7 == 0, ".5/80").when(F.col("o_orderkey") % 5 == 0, "").otherwise(" /80"))
    return table(spark, sf_dir, "orders").select("o_orderkey", clinical.systolic(shown).alias("systolic"))


@query
def clamp_default(spark, sf_dir):
    age = F.when(F.col("p_size") % 5 != 0, F.col("p_size") * 4 - 30)
    name = text.non_blank(F.when(F.col("p_size") % 3 == 0, F.lit(" ")).otherwise(F.col("p_name")), "Paciente sem nome")
    return table(spark, sf_dir, "part").select("p_partkey", clinical.clamp_age(age).alias("age"), name.alias("name"))


@query
def status_transition(spark, sf_dir):
    found = rules.transitions(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type", "error")
    return found.select("event_id", "user_id", "previous_status")


@query
def pending_alerts(spark, sf_dir):
    name = F.concat(F.when(F.col("o_orderkey") % 11 == 0, "Lactato ").otherwise("Exame "), F.col("o_orderkey").cast("string"))
    status = F.when(F.col("o_orderstatus") == "P", "pending").otherwise("done")
    return rules.pending_alerts(table(spark, sf_dir, "orders"), "o_custkey", name, status, "o_orderkey")


CODES = ("L40.5", "A41.9", "T81.4", "M05.3", "Z00")


def _coded_patients(spark, sf_dir):
    code = F.element_at(F.array(*map(F.lit, CODES)), (F.col("c_custkey") % len(CODES) + 1).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name", code.alias("code"))


@query
def protocol_apply(spark, sf_dir):
    told = catalogs.apply_protocols(_coded_patients(spark, sf_dir), "code", reference_data.protocols(spark), reference_data.DEFAULT_PROTOCOL)
    exams = told.select("c_custkey", F.lit("exam").alias("kind"), F.posexplode("exams").alias("pos", "item"))
    actions = told.select("c_custkey", F.lit("action").alias("kind"), F.posexplode("actions.description").alias("pos", "item"))
    return exams.unionByName(actions)


@query
def lookup_fallback(spark, sf_dir):
    code = F.element_at(F.array(*map(F.lit, ("L40.5", "L40.9", "A41.0", "Z00"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    rows = table(spark, sf_dir, "part").select("p_partkey", code.alias("code"))
    return catalogs.prioritised(rows, "code", reference_data.quick_questions(spark), reference_data.QUICK_PREFIXES, "default")


@query
def decision_flow(spark, sf_dir):
    told = catalogs.apply_protocols(_coded_patients(spark, sf_dir), "code", reference_data.protocols(spark), reference_data.DEFAULT_PROTOCOL)
    rows = told.select(F.col("c_custkey").alias("id"), "code", F.col("c_name").alias("name"), (F.col("c_custkey") % 90).cast("int").alias("age"), F.col("protocol_ref").alias("protocol"), "interaction", F.col("exams").alias("exam_names"), F.size("actions").alias("n_items"))
    return rules.flow_lines(rows, "2024-01-01 08:00:00")


# Catalogs.


def _catalog(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    known = part.filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("ordinal"), F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("code"), F.concat_ws(" ", "p_name", F.col("p_size").cast("string")).alias("label"), F.col("p_brand").alias("active_ingredient"), F.array(F.lit("base")).alias("source_tags"))
    names = part.filter("p_partkey % 2 = 1").select(F.col("p_partkey").alias("ordinal"), F.concat(F.lit("•"), "p_name", F.lit("  "), F.col("p_size").cast("string"), F.lit("*")).alias("name"))
    return known, names


@query
def catalog_merge(spark, sf_dir):
    rows = catalogs.merge(*_catalog(spark, sf_dir))
    return rows.select("code", "label", F.array_join(F.array_sort("source_tags"), ",").alias("tags"), "is_new")


@query
def catalog_codes(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ordinal"), F.col("p_name").alias("label"))
    used = table(spark, sf_dir, "region").select(F.upper("r_name").alias("code"))
    return catalogs.unique_codes(part, used)


@query
def catalog_list(spark, sf_dir):
    return catalogs.sorted_list(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name")


@query
def catalog_search(spark, sf_dir):
    return records.holding(table(spark, sf_dir, "part"), " Red ", "p_name", "p_brand").select("p_partkey", "p_name")


@query
def catalog_unselected(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_size", "p_brand").alias("p_name"))
    chosen = table(spark, sf_dir, "part").filter("p_partkey % 3 = 0").select(F.upper(F.concat_ws(" ", "p_name", "p_size", "p_brand")).alias("p_name"))
    return catalogs.unselected(part, chosen, "p_name").select("p_partkey", "p_name")


@query
def code_selectable(spark, sf_dir):
    code = F.concat(F.upper(F.substring("p_name", 1, 1)), F.lpad(F.col("p_size").cast("string"), 2, "0"), F.when(F.col("p_partkey") % 3 == 0, "-X").otherwise(".1"))
    return table(spark, sf_dir, "part").select("p_partkey", code.alias("code"), clinical.selectable_code(code).alias("selectable"))


# Manifests.


def _manifest(spark, sf_dir):
    rows = exact_dedup(spark, sf_dir)
    return rows.withColumn("status", F.when(F.col("doc_id") % 97 == 0, "error").otherwise(F.col("status")))


@query
def manifest_stats(spark, sf_dir):
    return incremental.status_counts(_manifest(spark, sf_dir), "status", ("ok", "skipped", "error", "pending"))


@query
def run_counters(spark, sf_dir):
    rows = cut(_manifest(spark, sf_dir).select("doc_id", "status"))
    return incremental.run_counters(rows, "doc_id", "status", ("ok", "skipped", "error"))


def _chunk_manifest(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.when(F.col("doc_id") % 7 == 0, "error").when(F.col("doc_id") % 5 == 0, "skipped").otherwise("ok").alias("status"), F.when(F.col("doc_id") % 4 != 0, F.concat(F.lit("d/"), F.col("doc_id").cast("string"), F.lit(".jsonl"))).otherwise("").alias("chunks_jsonl_relative_path"), (F.col("n_chars") * 1.0).alias("mtime"))


@query
def embed_candidates(spark, sf_dir):
    files = table(spark, sf_dir, "labels").select(F.concat(F.lit("d/"), F.col("doc_id").cast("string"), F.lit(".jsonl")).alias("path")).distinct()
    return incremental.embed_candidates(_chunk_manifest(spark, sf_dir), files).select("doc_id", "status")


@query
def incremental_embed(spark, sf_dir):
    done = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id").select("doc_id", F.when(F.col("quality") == 1, "embedded").otherwise("error").alias("status"), (F.col("n_chars") + F.when(F.col("doc_id") % 2 == 0, 0.0).otherwise(1.0)).cast("string").alias("chunks_mtime_unix"))
    return incremental.to_embed(_chunk_manifest(spark, sf_dir), done, "doc_id", "mtime").select("doc_id")


@query
def incremental_chunk(spark, sf_dir):
    inputs = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") * 1.0).alias("mtime"))
    outputs = table(spark, sf_dir, "labels").select("doc_id", (F.col("doc_id") + F.col("quality") - 0.5).alias("mtime"))
    return incremental.stale(inputs, outputs, "doc_id").select("doc_id")


@query
def manifest_scan(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    rows = pages.select(F.when(F.col("page_id") % 5 == 0, "error").otherwise("ok").alias("status"), F.lit("application/pdf").alias("content_type"), F.concat((F.col("page_id") % 100).cast("string"), F.when(F.col("page_id") % 3 == 0, ".PDF").otherwise(".html")).alias("relative_path"))
    files = pages.filter("page_id % 2 = 0").select(F.concat((F.col("page_id") % 100).cast("string"), F.lit(".PDF")).alias("path"))
    return incremental.scan_ready(rows, files)


@query
def manifest_upsert(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    existing = docs.select(F.col("doc_id").alias("key"), F.lit(0).alias("ord"), F.col("lang").alias("error"), F.col("n_chars").alias("n"))
    updates = labels.select((F.col("doc_id") * 2).alias("key"), F.lit(1).alias("ord"), F.lit(None).cast("string").alias("error"), F.col("quality").cast("long").alias("n"))
    return incremental.upsert(existing, updates, "key", "ord")


@query
def replace_by_key(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    target = docs.select("doc_id", F.col("n_chars").alias("n"))
    return incremental.replace_by_key(target, labels.select("doc_id", F.col("toxic").cast("long").alias("n")).distinct(), "doc_id")


# Streams and navigation.


@query
def sse_fold(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("event", F.when(F.col("turn") % 7 == 3, "error").when(F.col("role") == "assistant", "token").otherwise("sources"))
    told = web.fold_events(rows, "conv_id", "turn", "event", "text")
    return told.select("conv_id", digest(F.col("answer")).alias("answer"), "n_tokens", "failed")


@query
def chunk_nav(spark, sf_dir):
    counted = table(spark, sf_dir, "documents").select("doc_id", chunking.n_chunks(F.length("text")).alias("n")).filter("n > 0")
    rows = counted.withColumn("chunk_index", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return chunking.neighbours(rows, F.col("n")).drop("n")


@query
def json_props(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query
def weekly_volume(spark, sf_dir):
    week = F.floor(F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")) / 7)
    return table(spark, sf_dir, "events").groupBy("event_type", week.alias("week")).agg(F.count("*").alias("n"))


# Context for generation.


def _context(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "source", "text")
    found = vectors.passages(table_of(_neighbours(spark, sf_dir), "found"), docs, "vec_id")
    part = clinical.context_part(F.col("rank"), F.col("source"), F.col("vec_id"), F.lit(None), F.col("text"))
    return found.groupBy("query_id").agg(F.array_join(F.sort_array(F.collect_list(F.struct("rank", part.alias("part"))))["part"], clinical.CONTEXT_GAP).alias("context"))


@query
def context_block(spark, sf_dir):
    return _context(spark, sf_dir).withColumn("context", digest(F.col("context")))


@query
def prompt_text(spark, sf_dir):
    turns = records.last_user_turn(table(spark, sf_dir, "conversations")).select(F.col("conv_id").alias("query_id"), "text")
    told = turns.join(_context(spark, sf_dir), "query_id", "left")
    return told.select("query_id", digest(clinical.prompt(F.col("text"), F.col("context"))).alias("prompt"))


@query
def text_previews(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", digest(text.preview(F.col("text"), 200)).alias("preview"), digest(text.title(F.col("text"))).alias("title"))


@query
def flat_metadata(spark, sf_dir):
    m = F.struct(F.col("source").alias("source_stem"), F.when(F.col("doc_id") % 3 == 0, F.col("lang")).alias("section"), F.col("n_chars").alias("chunk_index"), F.when(F.col("doc_id") % 2 == 0, F.array("doc_id", F.col("doc_id") + 1)).alias("page_range"), F.array("lang", F.lit('a"b')).alias("tags"))
    rows = table(spark, sf_dir, "documents").select("doc_id", m.alias("metadata"))
    flat = rows.select("doc_id", chunking.flat_metadata(rows, "metadata").alias("m"))
    return flat.select("doc_id", *(F.try_element_at("m", F.lit(k)).alias(k) for k in ("source_stem", "section", "chunk_index", "page_range", "tags")), F.cardinality("m").alias("n"))


@query
def display_values(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", F.when(F.col("doc_id") % 2 == 0, F.array("doc_id", "n_chars")).alias("pages"))
    return rows.select("doc_id", records.display_value(F.when(F.col("doc_id") % 3 > 0, F.col("lang"))).alias("lang"), records.display_value(F.col("pages"), is_list=True).alias("pages"))


def _markdown(html: Column) -> Column:
    """A page as markdown: its parts and title as headers, scripts as fenced code, other tags dropped."""
    steps = (
        (r"(?s)<script>(.*?)</script>", "\n```\n## code\n$1\n```\n"),
        (r"<(nav|article|footer)>", "\n## $1\n"),
        (r"(?s)<h1>(.*?)</h1>", "\n### $1\n"),
        (r"<(p|li|div class=.ad.)>", "\n"),
        (r"<[^>]*>", ""),
    )
    for pattern, by in steps:
        html = F.regexp_replace(html, pattern, by)
    return html


@query
def section_split(spark, sf_dir):
    """Sections of every page under its headers; the header in fenced code is text."""
    docs = table(spark, sf_dir, "pages").select("page_id", _markdown(F.col("html")).alias("markdown"))
    told = chunking.sections(docs, "page_id", "markdown")
    return told.select("source_stem", "section", "header_1", "header_2", F.col("start").alias("char_start"), F.col("end").alias("char_end"), digest(F.col("text")).alias("body"))


def _pages_of_documents(spark, sf_dir):
    """Each document as pages of 3,000 characters, the first under a header of its source and language."""
    docs = table(spark, sf_dir, "documents").filter("doc_id is not null")
    pages = chunking.fixed_chunks(docs.select("doc_id", "text"), "doc_id", "text", size=3000, overlap=0).select("doc_id", F.col("chunk_index").alias("page"), F.col("chunk").alias("markdown"))
    head = F.when(F.col("page") % 4 == 0, F.concat(F.lit("## Part "), (F.col("page") / 4).cast("int").cast("string"), F.lit("\n"))).otherwise("")
    return pages.select("doc_id", (F.col("page") + 1).alias("page"), F.concat(head, "markdown").alias("markdown"))


@query
def recursive_chunks(spark, sf_dir):
    """Pages to stitched documents, sections, pieces, their pages and ids."""
    told = chunking.page_chunks(_pages_of_documents(spark, sf_dir), "doc_id", "page", "markdown")
    return told.select("chunk_id", "source_stem", "section", "chunk_index", F.col("start").alias("char_start"), F.col("end").alias("char_end"), "page_start", "page_end", digest(F.col("text")).alias("piece"))


@query
def sentence_pages(spark, sf_dir):
    """The turns that each sentence of a conversation touches, turns being the pages of one text."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("stem"), F.col("turn").alias("page"), "text")
    parts = chunking.whole_texts(turns, "stem", "page", "text").select("stem", F.posexplode(F.split("text", r"\. ")).alias("chunk_index", "part"))
    sized = parts.select("stem", "chunk_index", F.length("part").cast("long").alias("n"))
    pieces = windows.running_sum(sized, ["stem"], "chunk_index", F.col("n") + 2, "start").withColumn("end", F.col("start") + F.col("n")).drop("n")
    told = intervals.page_ranges(pieces, chunking.page_spans(turns, "stem", "page", "text"))
    return told.withColumnsRenamed({"stem": "conv_id", "start": "char_start", "end": "char_end"})


# Patients as a whole.


def _patients(spark, sf_dir):
    status = F.when(F.col("c_custkey") % 3 == 0, "admitted").otherwise("discharged")
    return _coded_patients(spark, sf_dir).select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), status.alias("status"), F.col("code").alias("cid_code"), F.concat(F.lit("label "), "code").alias("cid_label"))


def _exams(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("patient_id"), F.concat(F.lit("Exame "), F.col("o_orderkey").cast("string")).alias("name"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("requested_at"), F.when(F.col("o_orderstatus") == "P", "pending").when(F.col("o_orderstatus") == "F", "completed").otherwise("critical").alias("status"), F.lit(None).cast("string").alias("protocol_ref"), F.unix_date(F.col("o_orderdate").cast("date")).cast("long").alias("at_us"))


def _attachments(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_extendedprice").cast("string")).alias("id"), F.col("l_orderkey").alias("exam_id"), F.concat(F.lit("f"), F.col("l_linenumber").cast("string"), F.lit(".pdf")).alias("name"), F.lit("application/pdf").alias("mime"), F.col("l_partkey").alias("size"), F.concat(F.lit("up/"), F.col("l_partkey").cast("string")).alias("path"))


def _items(spark, sf_dir):
    e = table(spark, sf_dir, "events").filter("event_type in ('purchase', 'click')")
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("patient_id"), F.when(F.col("event_type") == "click", "exam").otherwise("review").alias("type"), F.when(F.col("event_id") % 4 == 0, "accepted").otherwise("suggested").alias("status"))


def _log(spark, sf_dir):
    e = table(spark, sf_dir, "events").filter("event_type = 'error'")
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("patient_id"), F.lit("admission").alias("step"), micros(F.col("ts")).alias("timestamp"), micros(F.col("ts")).alias("at_us"))


def _vitals(spark, sf_dir):
    e = table(spark, sf_dir, "events").filter("event_type = 'view'")
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("patient_id"), F.floor("value").cast("int").alias("heart_rate"), F.col("event_id").cast("string").alias("recorded_at"), micros(F.col("ts")).alias("at_us"))


@query
def patient_full(spark, sf_dir):
    return admissions.full_record(_patients(spark, sf_dir), _exams(spark, sf_dir), _attachments(spark, sf_dir), _items(spark, sf_dir), _log(spark, sf_dir), _vitals(spark, sf_dir))


@query
def alert_json(spark, sf_dir):
    rows = rules.vital_alerts(_patches(spark, sf_dir)).select("patient_id", "severity", "message", F.col("recorded_at").alias("created_at"), F.lit(False).alias("resolved"))
    return admissions.camel(rows).select(F.to_json(F.struct("patientId", "severity", "message", "createdAt", "resolved")).alias("body"))


@query
def patients_sorted(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.round("c_acctbal").alias("admitted_at"))
    return records.newest_first(rows, "admitted_at", "c_custkey")


@query
def alerts_sorted(spark, sf_dir):
    return records.newest_first(_alerts(spark, sf_dir).select("event_id", "team", micros(F.col("ts")).alias("ts_us")), "ts_us", "event_id")


@query
def exams_sorted(spark, sf_dir):
    return records.newest_first(_exams(spark, sf_dir).select("id", "patient_id", "at_us"), "at_us", "id")


@query
def items_sorted(spark, sf_dir):
    return _items(spark, sf_dir).orderBy("id")


@query
def log_sorted(spark, sf_dir):
    return records.newest_first(_log(spark, sf_dir).select("id", "step", "at_us"), "at_us", "id", key_descends=True)


@query
def first_manifest_rows(spark, sf_dir):
    return incremental.first_rows(table(spark, sf_dir, "pages").select("page_id", "url"), 25, "url", "page_id")


@query
def download_slice(spark, sf_dir):
    """A negative limit of the download drops rows from the end."""
    return incremental.first_rows(table(spark, sf_dir, "region"), -2, "r_regionkey", from_end=True)


@query
def exam_tab(spark, sf_dir):
    return records.by_status(_exams(spark, sf_dir), "critical").select("id", "patient_id")


@query
def grouped_actions(spark, sf_dir):
    told = records.grouped_items(_items(spark, sf_dir), "patient_id", "type", ["exam", "prescription", "observation"], "id")
    return told.select("patient_id", "ordinal", "type", F.array_join(F.transform("items", lambda i: i["id"].cast("string")), ",").alias("items"))


@query
def new_patient_fields(spark, sf_dir):
    k = F.col("c_custkey")
    blank = lambda m: F.when(k % m == 0, F.lit(None).cast("string")).when(k % m == 1, F.lit("  "))
    fields = records.default_fields(blank(3).otherwise(F.col("c_name")), blank(4).otherwise(F.lit(" visto ")), F.when(k % 2 == 0, F.lit("F")).otherwise(F.lit("")))
    return table(spark, sf_dir, "customer").select("c_custkey", *(c.alias(n) for n, c in fields.items()))


@query
def comorbidity_labels(spark, sf_dir):
    codes = [c for c, _, _ in reference_data.COMORBIDITIES][:5] + ["??"]
    code = F.element_at(F.array(*map(F.lit, codes)), (F.col("p_partkey") % len(codes) + 1).cast("int"))
    return catalogs.with_labels(table(spark, sf_dir, "part").select("p_partkey", code.alias("code")), "code", reference_data.comorbidities(spark))


@query
def code_library(spark, sf_dir):
    """A library's selectable codes; the fixed fallback rows where none is."""
    code = F.concat(F.upper(F.substring("p_name", 1, 1)), F.lpad(F.col("p_size").cast("string"), 2, "0"), F.when(F.col("p_partkey") % 3 == 0, "-X").otherwise(".1"))
    library = table(spark, sf_dir, "part").select(code.alias("code"), F.col("p_name").alias("label"))
    full = catalogs.usable_codes(library, reference_data.diagnoses(spark), clinical.selectable_code).withColumn("origin", F.lit("library"))
    none = catalogs.usable_codes(library.filter("code like '%-X'"), reference_data.diagnoses(spark), clinical.selectable_code).withColumn("origin", F.lit("fallback"))
    return full.unionByName(none)


@query
def toggled(spark, sf_dir):
    chosen, item = F.array(F.lit("a"), (F.col("p_partkey") % 3).cast("string")), (F.col("p_size") % 3).cast("string")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(catalogs.toggle(chosen, item), ",").alias("chosen"))


@query
def relative_paths(spark, sf_dir):
    path = F.concat(F.when(F.col("page_id") % 2 == 0, "/data/raw/").otherwise("/other/"), F.col("page_id").cast("string"), F.lit(".pdf"))
    return table(spark, sf_dir, "pages").select("page_id", text.relative_path(path, "/data/raw").alias("path"))


@query
def exam_units(spark, sf_dir):
    name = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("Lactato "), "p_name")).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", clinical.unit_of(name).alias("unit"))


@query
def breadcrumbs(spark, sf_dir):
    h1, h2 = F.when(F.col("p_partkey") % 3 > 0, F.col("p_name")), F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).otherwise(" ")
    return table(spark, sf_dir, "part").select("p_partkey", clinical.breadcrumb(h1, h2).alias("section"))


@query
def viewer_stats(spark, sf_dir):
    rows = _chunk_manifest(spark, sf_dir).select(F.col("doc_id").alias("source_stem"), "status", F.when(F.col("doc_id") % 6 == 0, "n/a").otherwise(F.col("doc_id").cast("string")).alias("chunk_count"))
    return incremental.viewer_stats(rows)


@query
def event_windows(spark, sf_dir):
    told = streams.windowed_counts(table(spark, sf_dir, "events"))
    return told.select(micros(F.col("window.start")).alias("start_us"), "event_type", "n")


@query
def catalog_extract(spark, sf_dir):
    """Names of the tables that the sizes of ``part`` make: headers in other words and order, one column short in each
    seventh, names with marks, and codes that are not well formed."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_name", "p_type")
    fourth = F.when(F.col("p_size") % 7 == 0, F.lit("Observação")).otherwise(F.lit("Código  ATC"))
    first = F.when(F.col("p_size") % 2 == 0, F.lit("DENOMINAÇÃO COMUM brasileira")).otherwise(F.lit("Denominação Comum"))
    heads = part.select("p_size").distinct().select(F.col("p_size").alias("table_id"), F.lit(0).cast("long").alias("row_no"), F.array(fourth, first, F.lit("Concentração/Composição"), F.lit("Forma Farmacêutica")).alias("cells"))
    code = F.when(F.col("p_partkey") % 3 == 0, "n/a").otherwise(F.concat(F.lit(" b0"), (F.col("p_partkey") % 10).cast("string"), F.lit("bb01 ")))
    rows = part.select(F.col("p_size").alias("table_id"), F.col("p_partkey").alias("row_no"), F.array(code, F.concat(F.lit("•"), "p_name", F.lit("*")), F.lit("5 mg"), F.col("p_type")).alias("cells"))
    names = catalogs.extract(heads.unionByName(rows.filter("row_no > 0")))
    return names.select(F.col("ordinal.table_id").alias("table_id"), F.col("ordinal.row_no").alias("row_no"), "name")


# Embedding of chunks.


def _chunks(spark, sf_dir):
    rows = chunking.fixed_chunks(table(spark, sf_dir, "documents").filter("doc_id is not null"), "doc_id", "text")
    return rows.select(F.col("doc_id").cast("string").alias("source_stem"), chunking.chunk_id(F.col("doc_id"), F.col("chunk_index")).alias("chunk_id"), "doc_id", "chunk_index", F.col("chunk").alias("text"))


@query
def chunk_embeddings(spark, sf_dir):
    """The components that are not 0 of every chunk's vector."""
    each = embedding.with_embeddings(_chunks(spark, sf_dir)).select("chunk_id", F.posexplode("embedding").alias("dimension", "value"))
    return each.filter("value != 0").withColumn("value", F.round("value", 6))


def _embedding_run(spark, sf_dir):
    """What a first run over every third document left, and the files as they are now: others' are new, and of each fifth
    the file has changed since."""
    chunks = _chunks(spark, sf_dir).select("source_stem", "chunk_id", "text")
    stems = table(spark, sf_dir, "documents").filter("doc_id is not null").select(F.col("doc_id").cast("string").alias("source_stem"), "doc_id", F.coalesce(F.col("n_chars"), F.lit(0)).cast("double").alias("mtime")).distinct()
    none = spark.createDataFrame([], "source_stem string, status string, embedded_count long, chunks_mtime_unix double")
    empty = spark.createDataFrame([], "source_stem string, chunk_id string, embedding array<double>")
    first = stems.filter("doc_id % 3 = 0").withColumn("mtime", F.col("mtime") - F.when(F.col("doc_id") % 5 == 0, 1).otherwise(0)).drop("doc_id")
    store, manifest, _ = embedding.embed_changed(chunks, first, none, empty)
    return chunks, stems.drop("doc_id"), table_of(manifest, "manifest"), table_of(store, "vectors")


@query
def embed_store(spark, sf_dir):
    """The manifest after the second run, with the vectors that the store has of each document."""
    chunks, files, manifest, store = _embedding_run(spark, sf_dir)
    after, rows, told = embedding.embed_changed(chunks, files, manifest, store)
    counts = after.groupBy("source_stem").agg(F.count("*").alias("n_vectors"), F.count_distinct("chunk_id").alias("n_ids"))
    run = told.select("source_stem", F.lit(True).alias("in_run"))
    both = rows.join(counts, "source_stem", "left").join(run, "source_stem", "left")
    return both.select("source_stem", "status", "embedded_count", "chunks_mtime_unix", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_vectors", "n_ids")), F.coalesce("in_run", F.lit(False)).alias("in_run"))


@query
def embed_rerun(spark, sf_dir):
    """A run over what a run has left embeds nothing."""
    chunks, files, manifest, store = _embedding_run(spark, sf_dir)
    after, rows, told = embedding.embed_changed(chunks, files, manifest, store)
    store, manifest = table_of(after, "vectors"), table_of(rows, "manifest")
    again, _, nothing = embedding.embed_changed(chunks, files, manifest, store)
    count = lambda n, run, kept: run.agg(F.lit(n).alias("run"), F.count("*").alias("documents")).crossJoin(kept.agg(F.count("*").alias("vectors")))
    return count(2, told, store).unionByName(count(3, nothing, again))


@query
def chunk_knn(spark, sf_dir):
    """The chunks nearest to the first chunk of each fiftieth document, by the vectors of ``chunk_embeddings``."""
    rows = embedding.with_embeddings(_chunks(spark, sf_dir)).select((F.col("doc_id") * 100000 + F.col("chunk_index")).alias("vec_id"), "embedding")
    found = vectors.nearest(rows, F.col("vec_id") % (50 * 100000) == 0, k=4)
    return found.select("query_id", "rank", F.round("distance", 6).alias("distance"))


# Changes of state.

WHEN = "2024-02-01T00:00:00"


def _readmit(spark, sf_dir):
    patients = _patients(spark, sf_dir)
    return patients, admissions.readmissible(patients, patients.filter("id % 10 = 0"))


@query
def readmit_patients(spark, sf_dir):
    return _readmit(spark, sf_dir)[1].select("id", F.when(F.col("refused"), F.col("status")).otherwise("admitted").alias("status"), "refused")


@query
def readmit_exams(spark, sf_dir):
    """All exams after the readmissions: those of the readmitted are deleted and their protocol's are new."""
    fine = _readmit(spark, sf_dir)[1].filter("not refused")
    new, _, _ = admissions.protocol_children(fine, reference_data.protocols(spark), reference_data.DEFAULT_PROTOCOL, "readmission", WHEN)
    old = _exams(spark, sf_dir).select(F.concat(F.lit("ex-"), F.col("id").cast("string")).alias("id"), "patient_id", "name", "status")
    after = records.replace_children(old, fine.select(F.col("id").alias("patient_id")), "patient_id", new.select("id", "patient_id", "name", "status"))
    return after


@query
def readmit_vitals(spark, sf_dir):
    fine = _readmit(spark, sf_dir)[1].filter("not refused")
    return admissions.readmitted_vitals(fine, _vitals(spark, sf_dir), ["at_us", "id"], F.lit(WHEN))


@query
def code_change(spark, sf_dir):
    """Suggested items and log of the patients whose code changed."""
    patients = _patients(spark, sf_dir)
    asked = patients.filter("id % 7 = 0").select("id", F.lit("A41.9").alias("cid_code"), F.lit("Sepse").alias("cid_label"))
    moved = admissions.code_changes(patients, asked)
    _, items, log = admissions.protocol_children(moved, reference_data.protocols(spark), reference_data.DEFAULT_PROTOCOL, "cid-update", WHEN)
    return items.select("id", "patient_id", "description").unionByName(log.select(F.lit("log").alias("id"), "patient_id", F.col("detail").alias("description")))


@query
def coded_after(spark, sf_dir):
    patients = _patients(spark, sf_dir)
    asked = patients.filter("id % 7 = 0").select("id", F.lit("A41.9").alias("cid_code"), F.lit("Sepse").alias("cid_label"))
    return admissions.changed(patients, admissions.code_changes(patients, asked)).select("id", "cid_code", "cid_label")


@query
def cascade_delete(spark, sf_dir):
    gone = _patients(spark, sf_dir).filter("id % 5 = 0")
    left = admissions.cascade(gone, exams=_exams(spark, sf_dir), items=_items(spark, sf_dir), attachments=_attachments(spark, sf_dir))
    one = lambda n: left[n].agg(F.count("*").alias("n")).withColumn("table", F.lit(n))
    return one("exams").unionByName(one("items")).unionByName(one("attachments"))


@query
def bulk_accept(spark, sf_dir):
    return admissions.accept_all(_items(spark, sf_dir), _patients(spark, sf_dir).filter("id % 2 = 0")).select("id", "status")


@query
def upload_guard(spark, sf_dir):
    exams = _exams(spark, sf_dir).withColumn("source", F.when(F.col("id") % 2 == 0, "manual").otherwise("protocol"))
    return admissions.upload_target(exams, _attachments(spark, sf_dir).select("exam_id", "path"))


def _exam_updates(events):
    status = F.when(F.col("event_type") == "error", "critical").otherwise(F.col("event_type"))
    result = F.when(F.col("event_id") % 3 == 0, F.lit(None).cast("string")).when(F.col("event_id") % 3 == 1, F.lit("")).otherwise(F.col("value").cast("int").cast("string"))
    return events.select(F.col("user_id").alias("id"), F.col("user_id").alias("patient_id"), F.col("event_id").alias("at"), F.concat(F.lit("Exame "), F.col("user_id").cast("string")).alias("name"), status.alias("status"), result.alias("result"))


@query
def critical_results(spark, sf_dir):
    told = rules.critical_result_alerts(_exam_updates(table(spark, sf_dir, "events")), "id", ["at"], "status", F.col("name"), F.col("result"))
    return told.select("id", "patient_id", "at", "severity", "category", "message", "team")


@query
def stream_critical_results(spark, sf_dir):
    """The same alerts from a stream, with an exam's last status as state."""
    events = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parque[t]")
    out = scratch(spark, "critical")
    streams.critical_stream(_exam_updates(events), out, scratch(spark, "offsets")).awaitTermination()
    return spark.read.parquet(out)


# Histories.


def _history_tables(spark, sf_dir):
    text = lambda prefix: F.concat(F.lit(prefix), F.col("id").cast("string")).alias("id")
    null = lambda c: F.lit(None).cast("string").alias(c)
    return {
        "patients": _patients(spark, sf_dir).withColumn("admitted_at", F.lit("2023-12-01T00:00:00")),
        "exams": _exams(spark, sf_dir).select(text("ex-"), "patient_id", "name", "requested_at", "status", null("source"), null("protocol_ref")),
        "items": _items(spark, sf_dir).select(text("sa-"), "patient_id", "type", null("description"), "status", null("protocol_ref")),
        "log": _log(spark, sf_dir).select(text("al-"), "patient_id", "step", null("status"), null("detail"), F.col("timestamp").cast("string").alias("timestamp")),
        "vitals": _vitals(spark, sf_dir).select(text("vs-"), "patient_id", "heart_rate", F.format_string("%020d", "at_us").alias("recorded_at")),
    }


@query
def readmission_history(spark, sf_dir):
    """Each patient before and after every tenth is readmitted, from the appended logs: status, time, exams, items, log
    and vitals."""
    tables = {n: table_of(t, n) for n, t in _history_tables(spark, sf_dir).items()}
    changes, _ = history.readmission(tables, tables["patients"].filter("id % 10 = 0"), reference_data.protocols(spark), reference_data.DEFAULT_PROTOCOL, F.lit(1), WHEN, ["recorded_at", "id"])
    logs = {}
    for name, t in tables.items():
        path = scratch(spark, f"log-{name}")
        history.append(history.puts(t, F.lit(0)), path, "first")
        for _ in range(2):  # a batch appended again replaces itself
            history.append(changes[name], path, "readmission")
        logs[name] = history.log_of(spark, path)
    told = []
    for moment in (0, 1):
        now = {n: history.state_at(log, "id", F.lit(moment)) for n, log in logs.items()}
        count = lambda n: now[n].groupBy(F.col("patient_id").alias("id")).agg(F.count("*").alias(f"n_{n}"))  # noqa: E731,B023
        last = windows.latest(now["vitals"], "patient_id", "recorded_at", "id").select(F.col("patient_id").alias("id"), "heart_rate")
        rows = now["patients"].select(F.lit(moment).alias("moment"), "id", "status", "admitted_at")
        for side in (*map(count, ("exams", "items", "log", "vitals")), last):
            rows = rows.join(side, "id", "left")
        told.append(rows.fillna(0, [f"n_{n}" for n in ("exams", "items", "log", "vitals")]))
    return told[0].unionByName(told[1])


@query
def state_at_times(spark, sf_dir):
    """What each user's state was half an hour after every seventh event, by the log of all events; a purchase deletes."""
    events = table(spark, sf_dir, "events").filter("ts is not null")
    log = events.select("user_id", "event_type", "value", micros(F.col("ts")).alias(history.AT), F.col("event_id").alias(history.SEQ), F.when(F.col("event_type") == "purchase", history.DELETE).otherwise(history.PUT).alias(history.OP))
    asks = events.filter("event_id % 7 = 0").select("event_id", "user_id", (micros(F.col("ts")) + 1_800_000_000).alias("asked_us"))
    told = history.state_for(asks, log, "user_id", F.col("asked_us"), "was")
    return told.select("event_id", "user_id", "asked_us", F.col("was.event_type").alias("event_type"), F.col("was.value").alias("value"))


# Streams by event time.


def _event_stream(spark, sf_dir):
    return spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parque[t]")


@query
def stream_ordered_results(spark, sf_dir):
    """Exams that became critical by the times of their updates, as far as the watermark came."""
    events = _event_stream(spark, sf_dir)
    status = F.when(F.col("event_type") == "error", "critical").otherwise(F.col("event_type"))
    result = F.when(F.col("event_id") % 3 == 2, F.col("value").cast("int").cast("string"))
    name = F.concat(F.lit("Exame "), F.col("user_id").cast("string"))
    updates = events.select(F.col("user_id").alias("id"), F.col("user_id").alias("patient_id"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), name.alias("name"), status.alias("status"), result.alias("result"))
    out = scratch(spark, "ordered")
    ordered.ordered_critical_stream(updates, out, scratch(spark, "offsets")).awaitTermination()
    return spark.read.parquet(out)


@query
def stream_windows(spark, sf_dir):
    """Events by hour and type, of the hours that the watermark has closed."""
    out = scratch(spark, "windows")
    ordered.window_stream(_event_stream(spark, sf_dir), out, scratch(spark, "offsets")).awaitTermination()
    return spark.read.parquet(out).select(micros(F.col("start")).alias("start_us"), "event_type", "n")


@query
def stream_sessions(spark, sf_dir):
    """Each user's sessions that the watermark has closed."""
    out = scratch(spark, "sessions")
    ordered.session_stream(_event_stream(spark, sf_dir), out, scratch(spark, "offsets")).awaitTermination()
    return spark.read.parquet(out).select("user_id", micros(F.col("start")).alias("start_us"), micros(F.col("end")).alias("end_us"), "n")
