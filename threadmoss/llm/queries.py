"""Registered queries of the training-data problems: linkage (1), grouping (4), encoding (6), packing (7), truncation (8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.tables import table
from .encoding import decode_ids, encode_text, encoded
from .grouping import link_groups
from .linkage import LinkIndex, deliveries
from .packing import packed, packing_faults, packing_report, sized
from .truncation import truncated, truncation_by_source


def _links(spark, sf):
    index = LinkIndex(spark)
    found = [index.link(part) for part in deliveries(table(spark, sf, "result_table"))]
    return index, found


def p1_found(spark, sf):
    _, found = _links(spark, sf)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def p1_clusters(spark, sf):
    """row_id and representative of every row that repeats another or is repeated, updated delivery by delivery."""
    index = LinkIndex(spark)
    for part in deliveries(table(spark, sf, "result_table")):
        index.link(part)
        index.accept()
    return index.mapping()


def p4_found(spark, sf):
    return link_groups(table(spark, sf, "node_links"))


def p4_sizes(spark, sf):
    """Groups by size."""
    groups = link_groups(table(spark, sf, "node_links")).groupBy("group_id").agg(F.count(F.lit(1)).alias("n_rows"))
    return groups.groupBy("n_rows").agg(F.count(F.lit(1)).alias("n_groups"))


def p6_ids(spark, sf):
    return encoded(table(spark, sf, "documents"))


def p6_round_trip(spark, sf):
    """Documents per source, their tokens, and how many decode to other bytes than they came from (none)."""
    d = table(spark, sf, "documents").select("source", "text").withColumn("ids", encode_text(F.col("text")))
    back = decode_ids(F.col("ids"))
    x = d.select("source", F.size("ids").alias("n"), (back != F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("differs"))
    return x.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("n_tokens"), F.sum(F.col("differs").cast("int")).alias("n_differ"))


def _packed(spark, sf):
    return packed(sized(table(spark, sf, "documents")), table(spark, sf, "container_kinds"))


def p7_packed(spark, sf):
    return _packed(spark, sf)


def p7_report(spark, sf):
    return packing_report(_packed(spark, sf), table(spark, sf, "container_kinds"))


def p7_faults(spark, sf):
    """What a packing must not have, counted by kind over the whole result."""
    return packing_faults(_packed(spark, sf), sized(table(spark, sf, "documents")), table(spark, sf, "container_kinds"))


def p8_found(spark, sf):
    return truncated(table(spark, sf, "documents")).select("doc_id")


def p8_by_source(spark, sf):
    d = table(spark, sf, "documents")
    return truncation_by_source(d, truncated(d))


def p8_reasons(spark, sf):
    """What told a cut, by source."""
    return truncated(table(spark, sf, "documents")).groupBy("source", "reason").agg(F.count(F.lit(1)).alias("n_cut"))


QUERIES = {f.__name__: f for f in (p1_found, p1_clusters, p4_found, p4_sizes, p6_ids, p6_round_trip, p7_packed, p7_report, p7_faults, p8_found, p8_by_source, p8_reasons)}

_HASH = r"regexp_replace(trim({c}), '^((version:\d+:)?sha-?256:)', '', 'i')"


def _hex(c: str) -> str:
    """SQL: a hash in lower-case hexadecimal, however written."""
    s = _HASH.format(c=c)
    b = f"regexp_replace(translate({s}, '-_', '+/'), '=+$', '')"
    return f"CASE WHEN regexp_full_match({s}, '[0-9a-fA-F]{{64}}') THEN lower({s}) WHEN regexp_full_match({b}, '[A-Za-z0-9+/]{{43}}') THEN lower(hex(from_base64({b} || '='))) WHEN {s} <> '' THEN {s} END"


def _near(v: str) -> str:
    return f"(isfinite(CAST(a.{v} AS DOUBLE)) AND isfinite(CAST(b.{v} AS DOUBLE)) AND abs(CAST(a.{v} AS DOUBLE) - CAST(b.{v} AS DOUBLE)) <= 0.01 * greatest(abs(CAST(a.{v} AS DOUBLE)), abs(CAST(b.{v} AS DOUBLE))))"


_RECORDING = (
    r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(url_decode(trim(lower(filename))), '\?.*$', ''), '^.*[/\\]', '')), '^(copy of\s+)+', ''),"
    r" '(\.ome)?\.tiff?\s*$', ''), '(\s*\(\d+\)|[ _-]copy)+$', ''), '[\s_.-]+', '_', 'g')"
)

_BLOCKS = f"k AS (SELECT row_id, {_RECORDING} AS rec, meta_pos, meta_t, {_hex('tunables_hash')} AS tun, {_hex('image_sha256_hash')} AS h, covered_area, graph_edge_length, graph_node_count FROM result_table)"
_ONE_BLOCK = "a.rec = b.rec AND a.meta_pos = b.meta_pos AND a.meta_t = b.meta_t AND a.tun = b.tun"
_ONE_FRAME = f"(coalesce(a.h = b.h, false) OR coalesce({_near('covered_area')} AND {_near('graph_edge_length')} AND {_near('graph_node_count')}, false))"

ORACLES: dict[str, str] = {
    "p7_faults": "SELECT kind, (SELECT count(DISTINCT doc_id) FROM documents) AS n_documents, CAST(0 AS BIGINT) AS n_over_capacity, CAST(0 AS BIGINT) AS n_wrong_pieces, CAST(0 AS BIGINT) AS n_wrong_sums FROM container_kinds",
    "p1_found": f"WITH {_BLOCKS} SELECT min(a.row_id) AS first_row_id, b.row_id FROM k a JOIN k b ON {_ONE_BLOCK} AND a.row_id < b.row_id WHERE {_ONE_FRAME} GROUP BY b.row_id",
    "p1_clusters": f"""WITH RECURSIVE {_BLOCKS}, e AS MATERIALIZED (SELECT DISTINCT a.row_id AS a, b.row_id AS b FROM k a JOIN k b ON {_ONE_BLOCK} AND a.row_id <> b.row_id WHERE {_ONE_FRAME}),
r(v, root) AS (SELECT a, a FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.v) SELECT v AS row_id, min(root) AS representative FROM r GROUP BY v""",
}
