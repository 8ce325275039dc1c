"""The queries of the training-data operators, each over its whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.llm import contamination, neardup, neighbours, packing, pairs, quality, spam, split
from folioflow.operators.current import current_rows
from folioflow.sources import table
from folioflow.storage import materialize

DIM = 64


def chunk_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return current_rows(table(spark, sf_dir, "chunks"), "chunk_id", "updated_at", {"embedding": F.col("embedding")})


def chunk_classes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The class of each current chunk's text, and the texts of all versions with their classes."""
    chunks = table(spark, sf_dir, "chunks")
    text = F.col("text_for_embedding")
    cls, k2 = neardup.class_of(text)
    members = current_rows(chunks, "chunk_id", "updated_at", {"cls": cls, "k2": k2}).withColumnRenamed("chunk_id", "id")
    return materialize(members, "members"), chunks.select(cls, k2, text.alias("text"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of chunks whose sets of 3-word sequences have a Jaccard similarity of at least 0.6."""
    members, texts = chunk_classes(spark, sf_dir)
    links = neardup.near_duplicate_links(members, texts, width=3, threshold=0.6)
    return links.select(F.col("id_a").alias("chunk_id_a"), F.col("id_b").alias("chunk_id_b"))


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each chunk with the smallest chunk_id it is linked with at five words and 0.8, and its number of links."""
    groups = neardup.near_duplicate_groups(*chunk_classes(spark, sf_dir))
    return groups.withColumnsRenamed({"id": "chunk_id", "group": "group_id"})


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of chunks of which one is among the other's five most similar, at a cosine of at least 0.85."""
    near = neighbours.nearest(chunk_vectors(spark, sf_dir), "chunk_id", "embedding", dim=DIM, k=5, floor=0.85)
    return near.select(F.least("id", "neighbour").alias("chunk_id_a"), F.greatest("id", "neighbour").alias("chunk_id_b")).distinct()


def p4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most similar chunks, however far, of every chunk whose hashed id is divisible by 100."""
    near = neighbours.nearest(
        chunk_vectors(spark, sf_dir), "chunk_id", "embedding", dim=DIM, k=5, probes=neighbours.ALL, asked=lambda i: F.pmod(F.crc32(i), F.lit(100)) == 0
    )
    return near.withColumnsRenamed({"id": "chunk_id", "neighbour": "neighbour_id"})


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of at most 1,000 tokens, with 80 of overlap, of every chunk of more than 1,000 tokens."""
    large = F.length("text_for_embedding") >= (split.LIMIT + 1) * split.CHARS
    columns = {"text": F.when(large, F.col("text_for_embedding"))}  # shorter texts needn't travel
    current = current_rows(table(spark, sf_dir, "chunks"), "chunk_id", "updated_at", columns)
    pieces = split.split_oversized(current, "chunk_id", "text", limit=split.LIMIT, overlap=split.OVERLAP, chars=split.CHARS)
    return pieces.withColumnRenamed("id", "chunk_id")


def p2_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every split text put together again from its pieces, with the sizes and overlaps of these."""
    pieces = p2_pieces(spark, sf_dir)
    ordered = F.array_sort(F.collect_list(F.struct("chunk_index", "start", "end", "text")))
    every = pieces.groupBy("chunk_id").agg(ordered.alias("p"), F.max("token_count").alias("largest"))
    numbered = F.forall(F.transform("p", lambda x, i: x["chunk_index"] == i), lambda x: x)
    # As far back as the text goes: a first piece may be shorter than the overlap.
    overlaps = F.expr(f"forall(transform(slice(p, 2, size(p)), (x, i) -> p[i].end - x.start = least(p[i].end, {split.OVERLAP * split.CHARS})), ok -> ok)")
    whole = F.expr("array_join(transform(p, (x, i) -> if(i = 0, x.text, substring(x.text, cast(p[i - 1].end - x.start as int) + 1))), '')")
    return every.select("chunk_id", F.length(whole).alias("n_chars"), F.md5(whole).alias("digest"), numbered.alias("numbered"), overlaps.alias("overlap_kept"), (F.col("largest") <= split.LIMIT).alias("within_limit"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that were split."""
    return p2_pieces(spark, sf_dir).where("chunk_index = 0").select("chunk_id")


def p5_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word, symbol, line and common-word statistics of every chunk with text, the rules it fails, and its kind."""
    found = quality.text_quality(table(spark, sf_dir, "chunks"), "chunk_id", "text_for_embedding", table(spark, sf_dir, "common_words"), version_col="updated_at")
    return found.withColumnRenamed("id", "chunk_id")


def p5_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics that SQL can give too."""
    wide = ("mean_word_length", "line_end_share", "common_word_share", "symbol_ratio")
    return p5_statistics(spark, sf_dir).select("chunk_id", "n_words", "n_lines", *[F.round(c, 6).alias(c) for c in wide], F.array_contains("failed_rules", "words").alias("fails_words"), F.array_contains("failed_rules", "line_ends").alias("fails_line_ends"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that are lists, tables or junk."""
    return p5_statistics(spark, sf_dir).where("kind is not null").select("chunk_id", "kind")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defective query-answer pairs."""
    return pairs.defective_pairs(table(spark, sf_dir, "rag_queries"), table(spark, sf_dir, "common_words"))


def p7_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The training sequence of 2,048 tokens that each text, or piece of a longer text, goes to."""
    return packing.pack(table(spark, sf_dir, "documents"))


def p7_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the sequences are."""
    filled = p7_sequences(spark, sf_dir).groupBy("sequence_id").agg(F.sum("n_tokens").alias("used"), F.max(F.col("position") + F.col("n_tokens")).alias("end"))
    return filled.agg(F.count("*").alias("sequences"), F.sum("used").alias("tokens"), F.max("end").alias("fullest"), (F.sum("used") / (F.count("*") * 2048)).alias("used_share"))


def p7_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents placed, and how often a rule of the packing is broken: never."""
    placed = materialize(p7_sequences(spark, sf_dir), "placed")
    after = Window.partitionBy("sequence_id").orderBy("position")
    inside = placed.withColumn("next", F.lead("position").over(after)).agg(
        F.count_if(F.col("position") + F.col("n_tokens") > 2048).alias("overfull"), F.count_if(F.col("position") + F.col("n_tokens") > F.col("next")).alias("overlapping")
    )
    n, last = F.count("*"), F.max(F.struct("piece", "n_tokens"))["n_tokens"]
    document = placed.groupBy("doc_id").agg(n.alias("n"), F.countDistinct("piece").alias("pieces"), F.max("piece").alias("top"), F.sum("n_tokens").alias("tokens"), last.alias("last"))
    broken = (F.col("n") != F.col("pieces")) | (F.col("n") != F.col("top") + 1) | (F.col("tokens") != F.col("top") * 2048 + F.col("last"))
    outside = document.agg(F.count("*").alias("documents"), F.count_if(broken).alias("not_whole"), F.count_if((F.col("n") > 1) & (F.col("tokens") <= 2048)).alias("split_needlessly"))
    return inside.unpivot([], inside.columns, "rule", "n").unionByName(outside.unpivot([], outside.columns, "rule", "n"))


def p8_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold twelve consecutive words of an evaluation item, and where."""
    return contamination.leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_leaks(spark, sf_dir).select("doc_id", "item_id")


def p9_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every document the shares of prose, link lists, tag lists, menus and records."""
    return spam.page_kinds(table(spark, sf_dir, "documents"), table(spark, sf_dir, "common_words"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword-stuffed pages, link lists and tag lists."""
    return p9_pages(spark, sf_dir).where("spam").select("doc_id").distinct()


CURRENT = "(select * from chunks qualify row_number() over (partition by chunk_id order by updated_at desc nulls last) = 1)"


def shingle_pairs_sql(width: int, threshold: float) -> str:
    gram = " || ' ' || ".join(f"w[i + {k}]" for k in range(width))
    return f"""
with words as (select chunk_id, regexp_extract_all(lower(text_for_embedding), '[\\p{{L}}\\p{{N}}]+') w from {CURRENT} where text_for_embedding is not null),
grams as (select distinct chunk_id, {gram} g from words, unnest(range(1, len(w) - {width - 2})) t(i) where len(w) >= {width}),
sizes as (select chunk_id, count(*) n from grams group by 1),
both_sides as (select a.chunk_id x, b.chunk_id y, count(*) shared from grams a join grams b on a.g = b.g and a.chunk_id < b.chunk_id group by 1, 2)
select x as chunk_id_a, y as chunk_id_b from both_sides join sizes a on a.chunk_id = x join sizes b on b.chunk_id = y
where shared >= {threshold} * (a.n + b.n - shared)"""


GROUPS_SQL = f"""
with recursive pairs as ({shingle_pairs_sql(5, 0.8)}),
links as (select chunk_id_a u, chunk_id_b v from pairs union all select chunk_id_b, chunk_id_a from pairs),
reached(u, v) as (select u, v from links union select r.u, l.v from reached r join links l on r.v = l.u),
groups as (select u, min(v) least from reached group by 1), degrees as (select u, count(*) n from links group by 1)
select chunk_id, least(chunk_id, coalesce(g.least, chunk_id)) group_id, coalesce(n, 0) n_links
from {CURRENT} left join groups g on g.u = chunk_id left join degrees d on d.u = chunk_id where text_for_embedding is not null"""


P4_SQL = f"""
with usable as (select chunk_id, embedding::double[64] e from {CURRENT}
  where len(embedding) = 64 and not list_contains(list_transform(embedding, lambda x: isnan(x) or x is null or isinf(x)), true)
  and list_contains(list_transform(embedding, lambda x: x <> 0), true)),
near as (select a.chunk_id id, b.chunk_id other, round(array_cosine_similarity(a.e, b.e), 9) cosine from usable a, usable b where a.chunk_id <> b.chunk_id),
best as (select * from near qualify row_number() over (partition by id order by cosine desc, other) <= 5)
select distinct least(id, other) as chunk_id_a, greatest(id, other) as chunk_id_b from best where cosine >= 0.85"""

P2_SQL = f"select chunk_id from {CURRENT} where length(text_for_embedding) // 4 > 1000"

RESTORED_SQL = f"""select chunk_id, length(text_for_embedding)::int n_chars, md5(text_for_embedding) digest, true numbered, true overlap_kept, true within_limit
from {CURRENT} where length(text_for_embedding) // 4 > 1000"""

P7_SQL = """select 'documents' "rule", count(*) n from documents where length(text) > 0
union all select unnest(['not_whole', 'split_needlessly', 'overfull', 'overlapping']), 0"""

P5_SQL = f"""
with t as (select chunk_id, text_for_embedding t, regexp_replace(text_for_embedding, '^([\\s]*(_Section:[^\\n]*_|#{{1,6}} [^\\n]*)?[\\s]*(\\n|$))+', '') b from {CURRENT} where regexp_matches(text_for_embedding, '[^\\s\\x0B\\x{{85}}\\x{{A0}}\\p{{Z}}]')),
body as (select chunk_id, case when regexp_matches(b, '[^\\s\\x0B\\x{{85}}\\x{{A0}}\\p{{Z}}]') then b else t end b from t),
parts as (select chunk_id, b, list_filter(string_split(b, chr(10)), lambda x: regexp_matches(x, '[^\\s\\p{{Z}}]')) l, regexp_extract_all(b, '[\\p{{L}}\\p{{N}}]+') w, regexp_extract_all(b, '[^\\s\\p{{Z}}]+') k from body),
known as (select list(distinct lower(word)) c from common_words),
counts as (select chunk_id, len(w) n_words, len(l) n_lines, list_sum(list_transform(w, lambda x: length(x)))::double letters, len(k)::double tokens, list_sum(list_transform(k, lambda x: length(x)))::double chars,
  len(list_filter(l, lambda x: regexp_matches(x, '[.!?…:。！？]["''”’»)\\]]*[\\s\\p{{Z}}]*$')))::double ends, len(list_filter(w, lambda x: list_contains(c, lower(x))))::double common from parts, known)
select chunk_id, n_words, n_lines, round(coalesce(letters, 0) / greatest(n_words, 1), 6) mean_word_length, round(ends / n_lines, 6) line_end_share, round(common / greatest(n_words, 1), 6) common_word_share,
  round((chars - coalesce(letters, 0)) / greatest(tokens, 1), 6) symbol_ratio, n_words not between 50 and 100000 fails_words, ends / n_lines <= 0.12 fails_line_ends from counts"""

P8_SQL = """
with item_words as (select item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') w from eval_items),
windows as (select distinct item_id, least(12, len(w)) n, array_to_string(w[i : i + least(12, len(w)) - 1], ' ') g
  from item_words, unnest(range(1, greatest(1, len(w) - 11) + 1)) t(i) where len(w) > 0),
doc_words as (select doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') w from documents where text is not null),
sizes as (select distinct n from windows),
doc_windows as (select doc_id, n, array_to_string(w[i : i + n - 1], ' ') g from doc_words, sizes, unnest(range(1, len(w) - n + 2)) t(i))
select distinct doc_id, item_id from doc_windows join windows using (n, g)"""

QUERIES = {
    "p1_found": p1_found,
    "p1_groups": p1_groups,
    "p2_found": p2_found,
    "p2_pieces": p2_pieces,
    "p2_restored": p2_restored,
    "p4_found": p4_found,
    "p4_neighbours": p4_neighbours,
    "p5_found": p5_found,
    "p5_statistics": p5_statistics,
    "p5_counts": p5_counts,
    "p6_found": p6_found,
    "p7_sequences": p7_sequences,
    "p7_usage": p7_usage,
    "p7_invariants": p7_invariants,
    "p8_found": p8_found,
    "p8_leaks": p8_leaks,
    "p9_found": p9_found,
    "p9_pages": p9_pages,
}

SQL = {"p1_found": shingle_pairs_sql(3, 0.6), "p1_groups": GROUPS_SQL, "p2_found": P2_SQL, "p2_restored": RESTORED_SQL, "p7_invariants": P7_SQL, "p5_counts": P5_SQL, "p4_found": P4_SQL, "p8_found": P8_SQL}
