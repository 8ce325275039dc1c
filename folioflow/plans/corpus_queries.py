"""Queries over documents, pages, sections, blocks, figures and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.commits import CommitLog
from folioflow.functions import layout as L
from folioflow.functions import text as T
from folioflow.operators import blocks, chunking, embedding, images, incremental, profile, sections, upsert
from folioflow.operators.current import current_rows
from folioflow.plans import pipeline
from folioflow.plans.registry import CURRENT, NEXT_RUN, STRIP, query
from folioflow.sources import table
from folioflow.storage import scratch


def current_chunks(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return current_rows(table(spark, d, "chunks"), "chunk_id", "updated_at", {c: F.col(c) for c in columns})


PENDING = f"""
(with holding as (select chunk_id k, lower(content_hash) held_hash, model_version held_version from checkpoint join ingestion_runs using (run_id)
  where status in ('completed', 'partial') qualify row_number() over (partition by chunk_id order by embedded_at desc nulls last) = 1),
joined as (select c.chunk_id, c.doc_id, substr(sha256(text_for_embedding), 1, 16) content_hash, embedding_model_version, k, held_hash, held_version
  from {CURRENT} c left join holding on k = c.chunk_id left join documents d on d.doc_key = c.doc_id
  where text_for_embedding is not null and (last_ingested_at is null or last_ingested_at <= timestamptz '{NEXT_RUN}+00'))
select chunk_id, doc_id, content_hash, embedding_model_version, case when k is null then 'new'
  when content_hash is distinct from held_hash then 'changed' when embedding_model_version is distinct from held_version then 'version' end reason
from joined)"""


@query(f"select * from {PENDING} where reason is not null")
def p3_pending(spark: SparkSession, d: str) -> DataFrame:
    """The chunks that the next embedding run must process, and why: the output of the first commit of a new log."""
    chunks, checkpoint, runs, documents = (table(spark, d, n) for n in ("chunks", "checkpoint", "ingestion_runs", "documents"))
    log = CommitLog(spark, scratch(spark, "p3"))
    commit = incremental.embedding_run(log, chunks, checkpoint, runs, documents, NEXT_RUN)
    return log.spark.read.schema("chunk_id string, doc_id string, content_hash string, embedding_model_version string, reason string").parquet(commit["tables"]["output"])


@query(f"select chunk_id from {PENDING} where reason is not null")
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_pending(spark, d).select("chunk_id")


@query(f"""
with p as (select source, length({STRIP.format("coalesce(text, '')")}) n, doc_id % 3 images from documents),
g as (select source doc_id, count(*) page_count, sum(n)::bigint total_text_chars, count(*) filter (where images > 0) pages_with_images,
  sum(images)::bigint total_images, count(*) filter (where n < 50) scanned_pages from p group by 1)
select *, round(total_text_chars / page_count, 6) avg_chars_per_page,
  case when scanned_pages > page_count * 0.7::double then 'scanned' when total_images > 0 and total_text_chars / page_count > 200 then 'mixed_content'
    when total_text_chars / page_count > 200 then 'native_text' else 'sparse_text' end primary_type,
  case when primary_type = 'mixed_content' then 'full_layout_analysis' else 'text_extraction' end processing_strategy from g""")
def doc_profile(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "documents").withColumn("images", F.col("doc_id") % 3)
    return profile.document_profile(pages, "source", "text", "images")


@query(f"""
select chunk_id, length(text_for_embedding) n_chars from {CURRENT}
where length({STRIP.format("text_for_embedding")}) > 50 and length(text_for_embedding) - length(replace(text_for_embedding, chr(10), '')) < 10
  and not regexp_full_match({STRIP.format("text_for_embedding")}, '[0-9]+')""")
def chunk_quality_filter(spark: SparkSession, d: str) -> DataFrame:
    chunks = current_chunks(spark, d, "text_for_embedding")
    return chunks.where(chunking.keeps_chunk(F.col("text_for_embedding"))).select("chunk_id", F.length("text_for_embedding").cast("long").alias("n_chars"))


@query(f"""
with t as (select length(text_for_embedding) // 4 n from {CURRENT} where text_for_embedding is not null)
select count(*) n_chunks, min(n) min_tokens, max(n) max_tokens, round(avg(n), 4) avg_tokens, sum(n)::bigint total_tokens, round(sum(n)::double / 1000 * 0.00013, 6) cost_usd from t""")
def token_stats(spark: SparkSession, d: str) -> DataFrame:
    return profile.token_statistics(current_chunks(spark, d, "text_for_embedding"), "text_for_embedding")


@query(f"""
select coalesce(chunk_strategy, 'unknown') strategy, count(*) n_chunks, round(avg(length(text_for_embedding) // 4), 4) avg_tokens,
  count(*) filter (where coalesce(len(referenced_figures), 0) > 0) with_figures from {CURRENT} group by 1""")
def chunk_stats(spark: SparkSession, d: str) -> DataFrame:
    return profile.chunk_statistics(current_chunks(spark, d, "chunk_strategy", "text_for_embedding", "referenced_figures"))


@query("""
with s as (select doc_key, title, source || ' > ' || title path, doc_id % 1200 n from documents where source is not null and title is not null),
g as (select *, substr(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 50) slug from s)
select doc_key, slug, doc_key || '__' || slug || '__' || substr(sha256(path), 1, 8) || '__chunk' || case when n < 1000 then lpad(n::varchar, 3, '0') else n::varchar end chunk_id,
  case when path = title then '' else '_Section: ' || path || '_' || chr(10) || chr(10) end breadcrumb,
  regexp_replace(regexp_replace(lower(doc_key), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') doc_slug,
  upper(substr(replace(doc_key, '_', ' '), 1, 1)) || substr(replace(doc_key, '_', ' '), 2) nice_title from g""")
def slug_chunk_id(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("source is not null and title is not null")
    path = T.section_path(F.array("source"), F.col("title"))
    return docs.select(
        "doc_key", T.slugify(F.col("title")).alias("slug"), T.chunk_id(F.col("doc_key"), path, F.col("doc_id") % 1200).alias("chunk_id"),
        T.breadcrumb(path, F.col("title")).alias("breadcrumb"), T.document_slug(F.col("doc_key")).alias("doc_slug"), T.pretty_title(F.col("doc_key")).alias("nice_title"),
    )


@query("""
select substr(sha256(text), 1, 16) content_hash, substr(sha256('m::' || text), 1, 32) cache_key, count(*) n_docs, min(doc_id) first_doc from documents
where text is not null group by 1, 2 having count(*) > 1""")
def content_hash_dups(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null")
    keys = T.content_hash(F.col("text")).alias("content_hash"), T.cache_key(F.col("text"), F.lit("m")).alias("cache_key")
    return docs.groupBy(*keys).agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc")).where("n_docs > 1")


TOC = """(select source doc_id, doc_id ord, doc_key title, doc_id::int page_start, (max(doc_id) over (partition by source) + 5)::int page_count
  from documents where source is not null)"""


def _toc(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("source is not null")
    last = docs.groupBy("source").agg((F.max("doc_id") + 5).cast("int").alias("page_count"))
    toc = docs.select("source", F.col("doc_id").alias("ord"), F.col("doc_key").alias("title"), F.col("doc_id").cast("int").alias("page_start"))
    return toc.join(last, "source").withColumnRenamed("source", "doc_id")


@query(f"select *, coalesce(lead(page_start) over (partition by doc_id order by ord) - 1, page_count)::int page_end from {TOC}")
def toc_page_end(spark: SparkSession, d: str) -> DataFrame:
    return sections.page_ends(_toc(spark, d))


@query("""
with recursive p as (select source doc_id, doc_id::int page, """ + f"length({STRIP.format('text')}) // 4 tokens, row_number() over (partition by source order by doc_id) rn" + f"""
  from documents where source is not null and length({STRIP.format("coalesce(text, '')")}) > 0),
fold as (select doc_id, page, tokens, rn, 0 section, tokens total from p where rn = 1
  union all select p.doc_id, p.page, p.tokens, p.rn, case when f.total >= 850 then f.section + 1 else f.section end,
    case when f.total >= 850 then p.tokens else f.total + p.tokens end from fold f join p on p.doc_id = f.doc_id and p.rn = f.rn + 1),
last as (select source doc_id, max(doc_id)::int last_page from documents where source is not null group by 1),
final as (select doc_id, section, min(page) page_start, max(page) last_in, sum(tokens)::bigint tokens from fold group by 1, 2)
select doc_id, section, page_start, case when tokens >= 850 then last_in else last_page end page_end, tokens from final join last using (doc_id)""")
def page_packing(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "documents").where("source is not null")
    return sections.pack_pages(pages, "source", "doc_id", "text").select("doc_id", "section", "page_start", "page_end", "tokens")


@query(f"""
with recursive parts as (select doc_id, unnest(regexp_split_to_array(text, '\\n[ \\t\\r\\f\\x0B]*\\n[ \\t\\n\\r\\f\\x0B]*')) part, generate_subscripts(regexp_split_to_array(text, '\\n[ \\t\\r\\f\\x0B]*\\n[ \\t\\n\\r\\f\\x0B]*'), 1) i
  from documents where text is not null),
p as (select doc_id, {STRIP.format("part")} t, row_number() over (partition by doc_id order by i) rn from parts where {STRIP.format("part")} <> ''),
fold as (select doc_id, t, rn, 0 g, length(t) // 4 n from p where rn = 1
  union all select p.doc_id, p.t, p.rn, case when f.n + length(p.t) // 4 < 50 then f.g else f.g + 1 end,
    case when f.n + length(p.t) // 4 < 50 then f.n + length(p.t) // 4 else length(p.t) // 4 end from fold f join p on p.doc_id = f.doc_id and p.rn = f.rn + 1)
select doc_id, g::int paragraph, md5(string_agg(t, chr(10) || chr(10) order by rn)) digest from fold group by 1, 2""")
def paragraph_merge(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null")
    flat = docs.select("doc_id", F.posexplode(chunking.paragraphs(F.col("text"))).alias("paragraph", "t"))
    return flat.select("doc_id", "paragraph", F.md5("t").alias("digest"))


@query()
def section_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Documents as sections of their source, cut into token-bounded chunks."""
    docs = table(spark, d, "documents").where("title is not null")
    no_figures = F.array().cast("array<struct<element_id:string,description:string,decision:string>>")
    shaped = docs.select(
        F.col("doc_key").alias("doc_id"), F.col("doc_id").alias("ord"), F.col("title").alias("heading"), F.lit(1).alias("level"), F.array("source").alias("parent_path"),
        L.page_range(F.lit(1), F.col("page_count")).alias("page_range"), "text", no_figures.alias("figures"),
    )
    return chunking.chunk_sections(shaped)


@query()
def character_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Documents as pages, cut into overlapping chunks of at most 750 characters."""
    return chunking.character_chunks(table(spark, d, "documents").select("doc_id", "text"), "text")


WORDS = """(select user_id page, event_id ord, event_type "text", (event_id % 500)::double x0, (value * 3)::double top, (event_id % 500 + 20)::double x1,
  (value * 3 + 10)::double bottom, case when event_id % 7 = 0 then 'Serif-Bold' else 'Serif' end fontname, (8 + event_id % 12)::double size from events where user_id is not null)"""


def _words(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("user_id is not null")
    return e.select(
        F.col("user_id").alias("page"), F.col("event_id").alias("ord"), F.col("event_type").alias("text"), (F.col("event_id") % 500).cast("double").alias("x0"),
        (F.col("value") * 3).alias("top"), (F.col("event_id") % 500 + 20).cast("double").alias("x1"), (F.col("value") * 3 + 10).alias("bottom"),
        F.when(F.col("event_id") % 7 == 0, "Serif-Bold").otherwise("Serif").alias("fontname"), (8 + F.col("event_id") % 12).cast("double").alias("size"),
    )


BLOCK_CLASS = "case when font_size >= 18 then 'TITLE' when font_size >= 14 or (is_bold and length(text) < 100) then 'SECTION_HEADER' when font_size >= 12 and is_bold then 'SUBSECTION_HEAADER' else 'TEXT' end"


@query(f"""
with w as (select *, lag(top) over o pt, lag(bottom) over o pb, lag(size) over o ps from {WORDS} window o as (partition by page order by ord)),
n as (select *, case when pt is null or not (abs(top - pt) < 5 or (top - pb < size * 1.5 and abs(size - ps) < 2)) then 1 else 0 end is_new from w),
b as (select *, sum(is_new) over (partition by page order by ord) block from n),
g as (select page, block::bigint block, string_agg(text, ' ' order by ord) "text", min(x0) x0, min(top) top, max(x1) x1, max(bottom) bottom, max(size) font_size,
  bool_or(fontname like '%Bold%') is_bold, count(*) n_words from b group by 1, 2)
select *, {BLOCK_CLASS} "type" from g""")
def word_blocks(spark: SparkSession, d: str) -> DataFrame:
    return blocks.word_blocks(_words(spark, d), ["page"])


@query(f"""
select page, ord from {WORDS} w where not exists (select 1 from (select p_partkey % 50 page, (p_partkey % 400)::double x0, p_partkey % 400 + 60.0::double x1, p_size * 2.0::double top, p_size * 2.0::double + 4 bottom from part) t
  where t.page = w.page and w.x0 <= t.x1 and w.x1 >= t.x0 and w.top <= t.bottom and w.bottom >= t.top)""")
def bbox_anti(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("p_partkey")
    boxes = table(spark, d, "part").select(
        (key % 50).alias("page"), (key % 400).cast("double").alias("x0"), (key % 400 + 60).cast("double").alias("x1"),
        (F.col("p_size") * 2.0).alias("top"), (F.col("p_size") * 2.0 + 4).alias("bottom"),
    )
    return blocks.outside_boxes(_words(spark, d), boxes, ["page"]).select("page", "ord")


@query(f"select page, ord, row_number() over (partition by page order by top, x0, ord)::int \"position\" from {WORDS}")
def reading_order(spark: SparkSession, d: str) -> DataFrame:
    return blocks.reading_order(_words(spark, d), ["page"]).select("page", "ord", "position")


FIGURES = """(select *, (p_partkey * 37) % 600 + 20 width_px, (p_partkey * 53) % 500 + 20 height_px, ((p_partkey * 11) % 500)::double x0, ((p_partkey * 29) % 700)::double top,
  ((p_partkey * 11) % 500 + (p_partkey * 7) % 300 + 10)::double x1, ((p_partkey * 29) % 700 + (p_partkey * 13) % 200 + 10)::double bottom, 612.0::double pw, 792.0::double ph,
  (p_partkey % 40)::int unique_colors, ((p_partkey % 100) / 100)::double top_5, (p_partkey % 30)::double edge, ((p_partkey % 10) / 10)::double white from part)"""


def _figures(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    box = F.struct(
        ((k * 11) % 500).cast("double").alias("x0"), ((k * 29) % 700).cast("double").alias("top"),
        ((k * 11) % 500 + (k * 7) % 300 + 10).cast("double").alias("x1"), ((k * 29) % 700 + (k * 13) % 200 + 10).cast("double").alias("bottom"),
    )
    visual = F.struct(
        (k % 40).cast("int").alias("unique_colors"), ((k % 100) / 100).alias("top_5_color_share"), (k % 30).cast("double").alias("edge_density"),
        ((k % 10) / 10).alias("whitespace_ratio"), F.lit(0.0).alias("pixel_variance"),
    )
    return table(spark, d, "part").select(
        k, ((k * 37) % 600 + 20).alias("width_px"), ((k * 53) % 500 + 20).alias("height_px"), box.alias("bbox"), F.lit(612.0).alias("page_width"), F.lit(792.0).alias("page_height"), visual.alias("visual")
    )


ROUTED = f"""(with s as (select *, least(width_px, height_px) least_px, (x1 - x0) * (bottom - top) / (pw * ph) area, width_px::double / height_px aspect, (x0 + x1) / 2 / pw rx, (top + bottom) / 2 / ph ry from {FIGURES}),
z as (select *, case when ry < 0.10::double and (rx < 0.15::double or rx > 0.85::double) then 'header_corner' when ry < 0.10::double then 'header' when ry > 0.90::double then 'footer' when rx < 0.10::double or rx > 0.90::double then 'margin' else 'body' end "zone" from s),
r as (select *, case when least_px < 80 or area < 0.01::double then 1 when "zone" in ('header_corner', 'footer') and least_px < 150 then 2 when unique_colors < 8 and least_px < 200 then 3
  when top_5 > 0.95::double and least_px < 300 then 4 when edge > 15 and white > 0.4::double then 5 when aspect > 1.3::double and area > 0.1::double then 6 else 7 end branch from z)
select p_partkey, "zone", case when branch <= 4 then 'skip_decorative' when branch = 5 then 'process_as_scan' when branch = 6 then 'process_as_diagram' else 'process_as_chart' end decision,
  case branch when 1 then printf('too_small: %dx%d, area=%.4f', width_px, height_px, area) when 2 then 'position_decorative: zone=' || "zone" when 3 then printf('few_colors_and_small: colors=%d, dim=%d', unique_colors, least_px)
    when 4 then printf('uniform_colors: top_5_share=%.2f', top_5) when 5 then 'high_text_density_pattern' when 6 then 'large_wide_image_in_body' else 'body_image_passed_all_filters' end reason,
  [0.95, 0.85, 0.80, 0.75, 0.75, 0.70, 0.60][branch]::double confidence from r)"""


@query(f"select * from {ROUTED}")
def image_route(spark: SparkSession, d: str) -> DataFrame:
    routed = images.route_measured(images.prepare_figures(_figures(spark, d)))
    return routed.select("p_partkey", "zone", "routing.decision", "routing.reason", "routing.confidence")


@query(f"""
with k as (select unnest(['skip_decorative', 'process_as_chart', 'process_as_diagram', 'process_as_scan', 'process_as_screenshot']) decision)
select decision, count(p_partkey) n from k left join {ROUTED} using (decision) group by 1""")
def routing_histogram(spark: SparkSession, d: str) -> DataFrame:
    return profile.histogram(image_route(spark, d), "decision", L.DECISIONS)


@query(f"""
select round(count(*) filter (where decision = 'skip_decorative') * 0.01::double, 4) saved_usd, round(count(*) filter (where decision in ('process_as_chart', 'process_as_diagram')) * 0.01::double, 4) vision_usd,
  round(count(*) filter (where decision = 'process_as_scan') * 0.001::double, 4) ocr_usd from {ROUTED}""")
def routing_cost(spark: SparkSession, d: str) -> DataFrame:
    return profile.routing_cost(image_route(spark, d))


@query(f"""
with s as (select *, coalesce(lead(page_start) over (partition by doc_id order by ord) - 1, page_count)::int page_end from {TOC}),
f as (select source doc_id, (doc_id + doc_id % 4)::int page, 'fig_' || doc_id element_id, decision from documents join {ROUTED} on p_partkey = doc_id where source is not null)
select s.doc_id, ord, page, element_id, decision, '[Figure on page ' || page || ': would be described by VLM in production]' description from s join f on f.doc_id = s.doc_id and page between page_start and page_end where decision <> 'skip_decorative'""")
def figure_range_join(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("source is not null")
    routed = image_route(spark, d).select(F.col("p_partkey").alias("doc_id"), "decision")
    figures = docs.join(routed.hint("merge"), "doc_id").select(F.col("source"), (F.col("doc_id") + F.col("doc_id") % 4).cast("int").alias("page"), F.concat(F.lit("fig_"), "doc_id").alias("element_id"), "decision")
    return sections.figures_in_sections(toc_page_end(spark, d), figures.withColumnRenamed("source", "doc_id"))


@query("""
select chunk_id, updated_at, case when page_range.lo is not null and page_range.hi is not null then '[' || page_range.lo || ',' || (page_range.hi + 1) || ')' end half_open from chunks""")
def page_range_text(spark: SparkSession, d: str) -> DataFrame:
    lo, hi = F.col("page_range.lo"), F.col("page_range.hi")
    return table(spark, d, "chunks").select("chunk_id", "updated_at", L.to_half_open(L.page_range(lo, hi)).alias("half_open"))


@query(f"""
with w as (select chunk_id, substr(sha256(text_for_embedding), 1, 16) content_hash, text_for_embedding t from {CURRENT} where text_for_embedding is not null),
c as (select distinct chunk_id, content_hash from checkpoint where model_version = '2031-02')
select chunk_id, w.content_hash, case when c.chunk_id is null then 'pending' else 'skipped' end status from w left join c using (chunk_id, content_hash)""")
def incremental_plan(spark: SparkSession, d: str) -> DataFrame:
    chunks = current_chunks(spark, d, "text_for_embedding").where("text_for_embedding is not null")
    return embedding.embedding_plan(chunks, table(spark, d, "checkpoint"), "2031-02").select("chunk_id", "content_hash", "status")


@query(f"""
with w as (select chunk_id, substr(sha256(text_for_embedding), 1, 16) content_hash, length(text_for_embedding) // 4 n from {CURRENT} where text_for_embedding is not null),
c as (select distinct chunk_id, content_hash, true covered from checkpoint where model_version = '2031-02'),
s as (select w.*, coalesce(covered, false) covered from w left join c using (chunk_id, content_hash))
select count(*) filter (where not covered) chunks_processed, count(*) filter (where covered) chunks_skipped, 0::bigint chunks_failed, coalesce(sum(n) filter (where not covered), 0)::bigint total_tokens,
  ceil(count(*) filter (where not covered) / 50)::bigint total_api_calls, round(coalesce(sum(n) filter (where not covered), 0)::double / 1000 * 0.00013, 6) total_cost_usd from s""")
def embedding_metrics(spark: SparkSession, d: str) -> DataFrame:
    chunks = current_chunks(spark, d, "text_for_embedding").where("text_for_embedding is not null")
    return embedding.run_metrics(embedding.embedding_plan(chunks, table(spark, d, "checkpoint"), "2031-02"))


@query()
def mock_embedding(spark: SparkSession, d: str) -> DataFrame:
    """Every current chunk's text through the deterministic embedder."""
    chunks = current_chunks(spark, d, "text_for_embedding")
    return embedding.embed(chunks, "text_for_embedding", lambda: embedding.HashEmbedder(64)).select("chunk_id", F.size("embedding").alias("n"), F.round(F.element_at("embedding", 1), 6).alias("first"))


@query("select run_id, doc_id, chunk_id, ((row_number() over (partition by doc_id order by chunk_id, updated_at) - 1) // 50)::bigint batch from chunks")
def batch_numbers(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "chunks").withColumn("_o", F.struct("chunk_id", "updated_at"))
    return chunks.withColumn("batch", embedding.batch_number(F.col("_o"), 50, "doc_id")).select("run_id", "doc_id", "chunk_id", "batch")


@query(f"""
with fresh as (select chunk_id, max(embedded_at) embedded_at from checkpoint group by 1), stored as (select chunk_id, 0.0::double embedded_at from {CURRENT})
select chunk_id, embedded_at from fresh union all select chunk_id, embedded_at from stored where chunk_id not in (select chunk_id from fresh)""")
def vector_merge(spark: SparkSession, d: str) -> DataFrame:
    """Keyed union of stored and fresh entries, the last fresh one of each key counting."""
    fresh = embedding.last_of_key(table(spark, d, "checkpoint"), "chunk_id", "embedded_at").select("chunk_id", "embedded_at")
    stored = current_chunks(spark, d).withColumn("embedded_at", F.lit(0.0))
    return embedding.merge_vectors(stored, fresh)


NOW = "2031-05-01 00:00:00"
INCOMING_DOC = """(select case when doc_id % 5 = 0 then doc_key || '_new' else doc_key end k, 'New ' || title title, source_path, case when doc_id % 4 = 0 then null else content_hash end content_hash, 'someone' author, 'v9' pipeline_version, doc_type from documents)"""


@query(f"""
select coalesce(o.doc_key, n.k) doc_key, case when n.k is not null then n.title else o.title end title, case when n.k is not null then n.content_hash else o.content_hash end content_hash,
  case when o.doc_key is null then n.author else o.author end author, case when n.k is not null then n.pipeline_version else o.pipeline_version end pipeline_version, case when o.doc_key is null then n.doc_type else o.doc_type end doc_type,
  case when n.k is not null then false else o.is_deleted end is_deleted, (case when n.k is not null then timestamptz '{NOW}+00' else o.last_ingested_at::timestamptz end) last_ingested_at,
  case when o.doc_key is null then 'inserted' when n.k is null then 'unchanged' else 'updated' end "action" from documents o full join {INCOMING_DOC} n on n.k = o.doc_key""")
def upsert_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    incoming = docs.select(
        F.when(F.col("doc_id") % 5 == 0, F.concat("doc_key", F.lit("_new"))).otherwise(F.col("doc_key")).alias("doc_key"), F.concat(F.lit("New "), "title").alias("title"), "source_path",
        F.when(F.col("doc_id") % 4 != 0, F.col("content_hash")).alias("content_hash"), F.lit("someone").alias("author"), F.lit("v9").alias("pipeline_version"), "doc_type",
    )
    out = upsert.upsert_documents(docs, incoming, F.to_timestamp(F.lit(NOW)), key="doc_key")
    return out.select("doc_key", "title", "content_hash", "author", "pipeline_version", "doc_type", "is_deleted", "last_ingested_at", "action")


STORED = f"(select chunk_id, content_hash, embedding_model_version, text_for_embedding, section_path, run_id, token_count, updated_at from {CURRENT})"
INCOMING = f"""(select case when length(chunk_id) % 9 = 0 then chunk_id || '_new' else chunk_id end chunk_id, case length(coalesce(text_for_embedding, '')) % 4 when 0 then content_hash when 1 then 'other' when 2 then null else content_hash end content_hash,
  case when length(coalesce(text_for_embedding, '')) % 7 = 0 then 'v9' else embedding_model_version end embedding_model_version, 'fresh ' || text_for_embedding text_for_embedding, section_path, 'run_9' run_id, 7 token_count from {CURRENT})"""
UPSERTED = f"""(select coalesce(o.chunk_id, n.chunk_id) chunk_id, o.chunk_id is null is_new, n.chunk_id is not null and (coalesce(o.content_hash <> n.content_hash, false) or coalesce(o.embedding_model_version <> n.embedding_model_version, false)) and o.chunk_id is not null hit, o, n
  from {STORED} o full join {INCOMING} n on n.chunk_id = o.chunk_id)"""


def _upserted(spark: SparkSession, d: str) -> DataFrame:
    names = ("content_hash", "embedding_model_version", "text_for_embedding", "section_path", "run_id", "token_count", "updated_at")
    stored = current_chunks(spark, d, *names)
    size = F.length(F.coalesce("text_for_embedding", F.lit("")))
    incoming = stored.select(
        F.when(F.length("chunk_id") % 9 == 0, F.concat("chunk_id", F.lit("_new"))).otherwise(F.col("chunk_id")).alias("chunk_id"),
        F.when(size % 4 == 1, "other").when(size % 4 != 2, F.col("content_hash")).alias("content_hash"),
        F.when(size % 7 == 0, "v9").otherwise(F.col("embedding_model_version")).alias("embedding_model_version"),
        F.concat(F.lit("fresh "), "text_for_embedding").alias("text_for_embedding"), "section_path", F.lit("run_9").alias("run_id"), F.lit(7).alias("token_count"),
    )
    return upsert.upsert_chunks(stored, incoming, F.to_timestamp(F.lit(NOW)))


@query(f"""
select chunk_id, case when is_new or hit then n.content_hash else o.content_hash end content_hash, case when is_new or hit then n.embedding_model_version else o.embedding_model_version end embedding_model_version,
  md5(case when is_new or hit then n.text_for_embedding else o.text_for_embedding end) digest, case when is_new or hit then n.run_id else o.run_id end run_id, case when is_new then n.token_count else o.token_count end token_count,
  (case when is_new or hit then timestamptz '{NOW}+00' else o.updated_at::timestamptz end) updated_at, case when is_new then 'inserted' when hit then 'updated' else 'unchanged' end "action" from {UPSERTED}""")
def upsert_chunks(spark: SparkSession, d: str) -> DataFrame:
    out = _upserted(spark, d)
    return out.select("chunk_id", "content_hash", "embedding_model_version", F.md5("text_for_embedding").alias("digest"), "run_id", "token_count", "updated_at", "action")


@query(f"""
select count(*) filter (where is_new) chunks_inserted, count(*) filter (where hit) chunks_updated, count(*) filter (where not is_new and not hit) chunks_unchanged, 2::bigint chunks_failed, 'partial' status, '["a","b"]' error_summary from {UPSERTED}""")
def run_outcome(spark: SparkSession, d: str) -> DataFrame:
    return upsert.run_outcome(_upserted(spark, d), F.lit(2).cast("long"), F.array(F.lit("a"), F.lit("b")))


@query("""
with m as (select list_filter([case when chunk_id is null then 'chunk_id' end, case when doc_id is null then 'doc_id' end, case when embedding is null then 'embedding' end, case when embedding_model is null then 'embedding_model' end,
  case when embedding_model_version is null then 'embedding_model_version' end, case when text_for_embedding is null then 'text_for_embedding' end, case when content_hash is null then 'content_hash' end], lambda x: x is not null) missing from chunks)
select array_to_string(missing, '+') missing, count(*) n from m group by 1""")
def malformed_records(spark: SparkSession, d: str) -> DataFrame:
    good, bad = upsert.split_malformed(table(spark, d, "chunks"))
    both = good.select(F.lit("").alias("missing")).unionByName(bad.select(F.array_join("missing", "+").alias("missing")))
    return both.groupBy("missing").agg(F.count("*").alias("n"))


@query("""
with f as (select doc_id, metadata m from chunks qualify row_number() over (partition by doc_id order by chunk_id, updated_at) = 1)
select doc_id, coalesce(m['doc_type'], 'unknown') doc_type, coalesce(m['doc_title'], doc_id) title, coalesce(m['source_system'], 'unknown') source_system, coalesce(m['access_classification'], 'internal') access_classification,
  coalesce(len(list_filter(map_keys(m), lambda k: k not in ('doc_title', 'doc_type', 'source_system', 'source_path', 'content_hash', 'page_count', 'author', 'publication_date', 'effective_date', 'expiry_date', 'access_classification', 'access_groups'))), 0)::bigint n_other from f""")
def first_record_doc(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "chunks").withColumn("_o", F.struct("chunk_id", "updated_at"))
    docs = upsert.document_from_chunk(upsert.first_records(chunks, "doc_id", "_o"))
    return docs.select("doc_id", "doc_type", "title", "source_system", "access_classification", F.size("metadata").cast("long").alias("n_other"))


@query("select chunk_id, updated_at, array_to_string(case when access_groups is null or len(access_groups) = 0 then ['all_advisors'] else access_groups end, ',') access from chunks")
def access_defaults(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").select("chunk_id", "updated_at", F.array_join(upsert.chunk_access(F.col("access_groups")), ",").alias("access"))


@query("select coalesce(embedding_model, '') model, chunk_type is null untyped, count(*) n_chunks from chunks group by 1, 2")
def corpus_summary(spark: SparkSession, d: str) -> DataFrame:
    out = profile.corpus_summary(table(spark, d, "chunks").withColumn("model", F.coalesce("embedding_model", F.lit(""))), "model", F.col("chunk_type").isNull())
    return out.withColumnsRenamed({"source": "model", "status": "untyped"})


@query("select chunk_type, count(*) n from chunks where chunk_type is not null group by 1")
def element_histogram(spark: SparkSession, d: str) -> DataFrame:
    return profile.histogram(table(spark, d, "chunks"), "chunk_type")


@query("""
with r as (select run_id, status, chunks_loaded, chunks_failed from ingestion_runs)
select run_id, status, chunks_loaded, chunks_failed from r union all select 'run_new', 'partial', 7, 2""")
def run_table(spark: SparkSession, d: str) -> DataFrame:
    """The run table with a run that was started and finished."""
    at = F.to_timestamp(F.lit(NOW))
    runs = upsert.start_run(table(spark, d, "ingestion_runs"), "run_new", at, operator="someone")
    outcome = spark.createDataFrame([(4, 3, 0, 2, "partial", None)], "chunks_inserted long, chunks_updated long, chunks_unchanged long, chunks_failed long, status string, error_summary string")
    return upsert.finish_run(runs, "run_new", at, outcome).select("run_id", "status", "chunks_loaded", "chunks_failed")


@query(f"""
with o as (select doc_id, chunk_id ord, section_heading title, section_level "level", page_range.lo page_start from {CURRENT} where section_level is not null and page_range.lo is not null),
u as (select *, max(case when "level" = 1 then {{'o': ord, 't': title}} end) over w above from o window w as (partition by doc_id order by ord rows between unbounded preceding and 1 preceding))
select doc_id, ord, title, "level", page_start, case when "level" = 2 and above is not null then [above.t] else []::varchar[] end parent_path from u""")
def document_outline(spark: SparkSession, d: str) -> DataFrame:
    """Chunks as entries of their documents' outlines, with the titles above each."""
    chunks = current_chunks(spark, d, "doc_id", "section_heading", "section_level", "page_range").where("section_level is not null")
    outline = chunks.select("doc_id", F.col("chunk_id").alias("ord"), F.col("section_heading").alias("title"), F.col("section_level").alias("level"), F.col("page_range.lo").alias("page_start"))
    return sections.walk_outline(outline)


PAGES = """(select source doc_id, doc_id::int page, coalesce(text, '') t from documents where source is not null)"""


@query(f"""
with s as (select *, coalesce(lead(page_start) over (partition by doc_id order by ord) - 1, last)::int page_end from
  (select doc_id, page::bigint ord, 'Page ' || page heading, page page_start, max(page) over (partition by doc_id) last from {PAGES} where page % 3 = 0))
select s.doc_id, ord, heading, page_start, page_end, md5(string_agg(t, chr(10) || chr(10) order by page)) digest from s join {PAGES} p on p.doc_id = s.doc_id and page between page_start and page_end
where page_end >= page_start group by all""".replace("max(page) over (partition by doc_id) last from " + PAGES + " where page % 3 = 0", "last from (select *, max(page) over (partition by doc_id) last from " + PAGES + ") where page % 3 = 0"))
def outline_sections(spark: SparkSession, d: str) -> DataFrame:
    """Sources as documents of which every third page has a heading: sections with the texts of their pages."""
    pages = table(spark, d, "documents").where("source is not null").select(F.col("source").alias("doc_id"), F.col("doc_id").cast("int").alias("page"), "text")
    outline = pages.where("page % 3 = 0").select("doc_id", F.col("page").cast("long").alias("ord"), F.concat(F.lit("Page "), "page").alias("title"), F.lit(1).alias("level"), F.col("page").alias("page_start"))
    found = pipeline.sections_from_outline(outline, pages)
    return found.select("doc_id", "ord", "heading", F.col("page_range.lo").alias("page_start"), F.col("page_range.hi").alias("page_end"), F.md5("text").alias("digest"))


@query("""
with t as (select chunk_id, updated_at, case when page_range.lo is not null and page_range.hi is not null then '[' || page_range.lo || ',' || (page_range.hi + 1) || ')' end h from chunks)
select chunk_id, updated_at, regexp_extract(h, '^.(-?[0-9]+),', 1)::int lo, regexp_extract(h, ',(-?[0-9]+).$', 1)::int - 1 hi from t where h is not null""")
def parsed_ranges(spark: SparkSession, d: str) -> DataFrame:
    parsed = page_range_text(spark, d).where("half_open is not null").withColumn("r", L.parse_half_open(F.col("half_open")))
    return parsed.select("chunk_id", "updated_at", "r.lo", "r.hi")


@query()
def image_pixels(spark: SparkSession, d: str) -> DataFrame:
    """Figures drawn from the part table, decoded only where size and position leave the decision open."""
    k = F.col("p_partkey")
    noise = F.unhex(F.concat(*[F.sha2(F.concat(k.cast("string"), F.lit(f":{i}")), 512) for i in range(3)]))
    image = F.concat(F.encode(F.lit("P6\n8 8\n255\n"), "utf-8"), noise)
    return images.route_images(_figures(spark, d).drop("visual").withColumn("image", image), "image").select("p_partkey", "routing.decision", "visual", "error")
