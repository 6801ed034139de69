"""Queries over the documents as a branched graph and their DuckDB forms: walks, seeds, crumbs, best-first search, gapless alignment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.functions import sequence as S
from strandloom.operators import align as A
from strandloom.operators import analysis as N
from strandloom.operators import graph as G
from strandloom.operators import runs as R
from strandloom.operators import seeds as D
from strandloom.operators import windows as W
from strandloom.operators.graph import character_graph
from strandloom.operators.lineage import settled
from strandloom.operators.search import search
from strandloom.plans.queries import DS, K, MATCHES, REVCOMP, RS, SEEDS, _t, link_table, query, read_table, sequences
from strandloom.sources.reads import first_reads

#: The most that search_graph pays, below the price of a gap, so that SQL need only count differing letters.
MOST = 2
#: Depth of the tries.
DEPTH = 6

# every document leads to the next of its source and to the next of its language; empty ones are no segments
GRAPH = (
    "seg AS (SELECT seg_id, seq, length(seq) - 1 AS n FROM ds WHERE seq <> ''), nexts AS (SELECT doc_id AS from_id, lead(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS to_id FROM documents "
    "UNION SELECT doc_id, lead(doc_id) OVER (PARTITION BY lang ORDER BY doc_id) FROM documents), bl AS (SELECT from_id, to_id FROM nexts WHERE to_id IN (SELECT seg_id FROM seg) AND from_id IN (SELECT seg_id FROM seg))"
)
WALKS = (
    f"go AS (SELECT seg_id AS s, o, to_id AS spot, substr(seq, (o + 1)::BIGINT) AS word FROM (SELECT *, unnest(generate_series(greatest(n - {K} + 1, 0), n)) AS o FROM seg) JOIN bl ON from_id = seg_id "
    f"UNION ALL SELECT s, o, to_id, word || seq FROM go JOIN seg ON spot = seg_id JOIN bl ON from_id = spot WHERE {K} - length(word) > n), "
    f"walks AS (SELECT s, o, spot AS es, {K} - length(word) AS eo, word || left(seq, {K} - length(word)) AS word FROM go JOIN seg ON spot = seg_id WHERE {K} - length(word) <= n "
    f"UNION ALL SELECT seg_id, o, seg_id, o + {K}, substr(seq, (o + 1)::BIGINT, {K}) FROM (SELECT *, unnest(generate_series(0, n - {K})) AS o FROM seg WHERE n >= {K}))"
)

#: Up to three ends of every read on the documents, turned to the read's own direction: `a` its letters, `b` the graph's.
GAPLESS = (
    f"{DS}, {RS}, most AS (SELECT max(length(seq)) AS most FROM rs), spots AS (SELECT seg_id, seq, unnest(generate_series(0, length(seq) - 1)) AS o FROM ds WHERE seq <> ''), "
    "windows AS (SELECT seg_id, o, substr(seq, (o + 1)::BIGINT, most) AS w FROM spots, most), "
    f"r AS (SELECT read_id, '+' AS strand, seq, length(seq) AS len FROM rs WHERE seq <> '' UNION ALL SELECT read_id, '-', {REVCOMP.format('seq')}, length(seq) FROM rs WHERE seq <> ''), "
    "met AS (SELECT read_id, strand, seg_id, o, hamming(left(w, len), seq) AS cost FROM r JOIN windows ON length(w) >= len), low AS (SELECT read_id, min(cost) AS cost FROM met GROUP BY 1), "
    "best AS (SELECT met.*, count(*) OVER (PARTITION BY read_id) AS n, row_number() OVER (PARTITION BY read_id ORDER BY strand, seg_id, o) AS rank FROM met JOIN low USING (read_id, cost)), "
    "spelt AS (SELECT b.*, r.seq, r.len, left(w, r.len) AS w FROM best b JOIN r USING (read_id, strand) JOIN windows USING (seg_id, o) WHERE rank <= 3), "
    f"turned AS (SELECT *, CASE WHEN strand = '+' THEN seq ELSE {REVCOMP.format('seq')} END AS a, CASE WHEN strand = '+' THEN w ELSE {REVCOMP.format('w')} END AS b FROM spelt) "
)


def branched_links(spark: SparkSession, d: str) -> DataFrame:
    """Links of every document to the next one of its source and to the next one of its language."""
    docs = _t(spark, d, "documents")
    to = [docs.select(F.col("doc_id").alias("from_id"), F.lead("doc_id").over(Window.partitionBy(c).orderBy("doc_id")).alias("to_id")) for c in ("source", "lang")]
    rows = to[0].unionByName(to[1]).where("to_id IS NOT NULL").distinct()
    return rows.select("from_id", F.lit(True).alias("from_fwd"), "to_id", F.lit(True).alias("to_fwd"), F.lit(0).alias("overlap"))


@query(
    f"WITH RECURSIVE {DS}, {RS}, {SEEDS}, {GRAPH}, {WALKS} SELECT read_id, seed::INTEGER AS seed, strand, count(*)::BIGINT AS n_walks FROM (SELECT DISTINCT read_id, seed, '+' AS strand, s, o FROM seeds JOIN walks ON kmer = word "
    f"UNION ALL SELECT DISTINCT read_id, seed, '-', es, eo FROM seeds JOIN walks ON {REVCOMP.format('kmer')} = word) GROUP BY 1, 2, 3"
)
def graph_seeds(spark, d):
    """The nodes of both strands from which a walk of the branched graph spells a seed."""
    runs, crossings = R.segment_runs(sequences(spark, d), branched_links(spark, d))
    found = R.seed_walks(settled(runs), settled(crossings), settled(D.seeds(read_table(spark, d), K)), K)
    return found.groupBy("read_id", "seed", F.when(F.col("run") >= 0, "+").otherwise("-").alias("strand")).agg(F.count("*").alias("n_walks"))


@query(
    f"{MATCHES}, c AS (SELECT DISTINCT read_id, seed, strand, seg_id, unnest(generate_series(greatest(0, p - start), p)) AS node FROM (SELECT *, CASE WHEN strand = '+' THEN pos ELSE length(seq) - pos - {K} END AS p FROM matches JOIN ds USING (seg_id))), "
    f"both_ AS (SELECT seg_id, '+' AS strand, seq FROM ds UNION ALL SELECT seg_id, '-', {REVCOMP.format('seq')} FROM ds), "
    f"u AS (SELECT DISTINCT read_id, seed, substr(seq, (node - m + 1)::BIGINT, m) AS prefix FROM (SELECT *, unnest(generate_series(0, least(node, {DEPTH - 1}))) AS m FROM c) JOIN both_ USING (seg_id, strand)) "
    "SELECT read_id, seed::INTEGER AS seed, n_nodes, n_prefixes FROM (SELECT read_id, seed, count(*)::BIGINT AS n_nodes FROM c GROUP BY 1, 2) JOIN (SELECT read_id, seed, count(*)::BIGINT AS n_prefixes FROM u GROUP BY 1, 2) USING (read_id, seed)"
)
def trie_crumbs(spark, d):
    """Crumbs of every seed on the documents' nodes, and on the nodes of their trie from which walks lead to these."""
    none = spark.createDataFrame([], "from_id long, from_fwd boolean, to_id long, to_fwd boolean, overlap int")
    runs, crossings = R.segment_runs(sequences(spark, d), none, drop_tail=False)
    runs, crossings = settled(runs), settled(crossings)
    matches = R.seed_walks(runs, crossings, D.seeds(read_table(spark, d), K), K)
    spans = settled(R.crumb_spans(runs, crossings, matches, F.col("start")))
    nodes = spans.groupBy("read_id", "seed").agg(F.sum((F.col("hi") - F.col("lo") + 1).cast("long")).alias("n_nodes"))
    up = R.walks_into_spans(runs, crossings, spans, DEPTH).groupBy("read_id", "seed").agg(F.count("*").alias("n_prefixes"))
    return nodes.join(up, ["read_id", "seed"])


@query(
    f"WITH RECURSIVE {DS}, {RS}, {GRAPH}, most AS (SELECT max(length(seq)) AS most FROM rs), ahead AS (SELECT from_id AS s, to_id AS spot, '' AS behind FROM bl UNION ALL SELECT s, to_id, behind || seq FROM ahead JOIN seg ON spot = seg_id JOIN bl ON from_id = spot, most WHERE length(behind) + n < most), "
    "ctx AS (SELECT DISTINCT s, left(behind || left(seq, n), most) AS more FROM ahead JOIN seg ON spot = seg_id, most WHERE length(behind) + n >= most OR spot NOT IN (SELECT from_id FROM bl)), "
    "spots AS (SELECT seg_id AS s, n, seq, unnest(generate_series(0, n)) AS o FROM seg), "
    "inside AS (SELECT n - o AS room, substr(left(seq, n), (o + 1)::BIGINT, most) AS w, true AS own FROM spots, most), "
    "beyond AS (SELECT n - o AS room, substr(seq, (o + 1)::BIGINT) || more AS w, false AS own FROM spots JOIN ctx USING (s), most WHERE n - o < most), "
    f"windows AS (SELECT * FROM inside UNION ALL SELECT * FROM beyond), r AS (SELECT read_id, seq, {REVCOMP.format('seq')} AS turned, length(seq) AS len FROM rs WHERE seq <> ''), "
    "low AS (SELECT read_id, min(least(hamming(left(w, len), seq), hamming(left(w, len), turned))) AS cost FROM r JOIN windows ON length(w) >= len AND (own OR room < len) GROUP BY 1) "
    f"SELECT rs.read_id, CASE WHEN seq = '' THEN 'none' WHEN cost <= {MOST} THEN 'found' ELSE 'overcost' END AS status, CASE WHEN cost <= {MOST} THEN cost END::INTEGER AS cost FROM rs LEFT JOIN low USING (read_id)"
)
def search_graph(spark, d):
    """The least cost of each read over the walks of the branched graph, up to MOST, by best-first search under the seed bound."""
    found = search(sequences(spark, d), branched_links(spark, d), read_table(spark, d), bound="seeds", depth=DEPTH, seed_len=K, max_cost=MOST, exact_first=True)
    return found.select("read_id", "status", "cost")


@query(
    f"WITH {GAPLESS} "
    "SELECT read_id, rank::INTEGER AS rank, CASE WHEN n > 1 THEN 'ambiguous' ELSE 'unique' END AS status, cost::INTEGER AS cost, strand, seg_id, (o + 1)::BIGINT AS start, "
    "array_to_string(list_transform(generate_series(1, len), lambda i: CASE WHEN a[i] = b[i] THEN a[i] ELSE lower(a[i]) END), '') AS spell, array_to_string(list_transform(generate_series(1, len), lambda i: CASE WHEN a[i] = b[i] THEN '-' ELSE a[i] END), '') AS track FROM turned "
    "UNION ALL SELECT read_id, 1, 'none', NULL, NULL, NULL, NULL, NULL, NULL FROM rs WHERE seq = ''"
)
def align_gapless(spark, d):
    """Every read against every document, both strands, where a gap costs more than any read has letters: up to three optimal ends."""
    found = A.align(sequences(spark, d), None, read_table(spark, d), costs=A.Costs(0, 1, 100, 100), k=3, seed_len=K, drop_tail=False)
    found = found.join(read_table(spark, d), "read_id")
    return found.select("read_id", "rank", "status", "cost", "strand", "seg_id", "start", "spell", S.difference_track(F.col("path"), F.col("seq")).alias("track"))


@query(
    f"WITH {GAPLESS}, t AS (SELECT read_id, cost, len, a, b, array_to_string(list_transform(generate_series(1, len), lambda i: CASE WHEN a[i] = b[i] THEN '.' ELSE 's' END), '') AS types, array_to_string(list_transform(generate_series(1, len), lambda i: CASE WHEN a[i] = b[i] THEN '-' ELSE a[i] END), '') AS error FROM turned WHERE rank = 1) "
    "SELECT read_id, concat_ws(chr(10), ' -- Summary -- ', '    ' || (len - cost)::VARCHAR || ' ORIG edges sum to a cost of 0', '    0 ins edges sum to a cost of 0', '    0 del edges sum to a cost of 0', '    ' || cost::VARCHAR || ' subst edges sum to a cost of ' || cost::VARCHAR, '    0 jump edges sum to a cost of 0', "
    "'  ' || cost::VARCHAR, '', ' -- Alignment -- ', 'read qual: ' || translate(a, 'ACGT', 'IH5#'), 'read erro: ' || error, 'orig read: ' || a, 'alig path: ' || a, 'orig path: ' || b, 'grnd seq?: ' || reverse(a), 'edge type: ' || types) AS printed FROM t"
)
def printed_alignments(spark, d):
    """The first alignment of every read as text: costs by type and the seven tracks; gaps cost more than any read has letters."""
    costs, reads = A.Costs(0, 1, 100, 100), read_table(spark, d)
    found = A.align(sequences(spark, d), None, reads, costs=costs, seed_len=K, drop_tail=False).where("rank = 1 AND path IS NOT NULL")
    met = found.join(reads, "read_id").join(sequences(spark, d).select("seg_id", F.col("seq").alias("graph")), "seg_id")
    part = F.substring("graph", F.col("start"), F.length("seq"))
    walk = F.when(F.col("strand") == "+", part).otherwise(S.reverse_complement(part))
    tracks = S.alignment_tracks(F.col("path"), F.col("seq"), F.translate("seq", "ACGT", "IH5#"), F.reverse("seq"), walk)
    return met.select("read_id", S.printed_alignment(tracks, S.cost_by_type(F.col("path"), *costs.all())).alias("printed"))


@query(
    f"WITH {DS}, {RS}, most AS (SELECT max(length(seq)) AS most FROM rs), spots AS (SELECT seq, unnest(generate_series(0, length(seq) - 1)) AS o FROM ds WHERE seq <> ''), windows AS (SELECT DISTINCT substr(seq, (o + 1)::BIGINT, most) AS w FROM spots, most), "
    f"r AS (SELECT read_id, seq, {REVCOMP.format('seq')} AS turned, length(seq) AS len FROM rs WHERE seq <> ''), low AS (SELECT read_id, any_value(len) AS len, min(least(hamming(left(w, len), seq), hamming(left(w, len), turned))) AS cost FROM r JOIN windows ON length(w) >= len GROUP BY 1), "
    "s AS (SELECT 'ORIG' AS name, sum(len - cost)::BIGINT AS n, 0::BIGINT AS cost FROM low UNION ALL SELECT 'subst', sum(cost), sum(cost) FROM low) SELECT name, n::BIGINT AS n, cost::BIGINT AS cost FROM s WHERE n > 0"
)
def path_costs(spark, d):
    """Steps of the reads' first alignments and what they cost, by the printed name of their type; gaps cost more than any read has letters."""
    costs = A.Costs(0, 1, 100, 100)
    found = A.align(sequences(spark, d), None, read_table(spark, d), costs=costs, seed_len=K, drop_tail=False)
    per = N.path_summary(found.where("path IS NOT NULL"), *costs.all())
    return per.select(S.edge_type_name(F.col("etype")).alias("name"), "n", F.col("cost").cast("long").alias("cost"))


@query(f"WITH {DS}, {RS}, {GRAPH} SELECT round((sum(length(rs.seq) - 1) / greatest(1, (SELECT sum(n) FROM seg) + (SELECT count(*) FROM bl)))::DOUBLE, 9) AS coverage FROM rs")
def coverage(spark, d):
    """Letters of the reads over the edges of one strand of the branched graph."""
    edges = character_graph(sequences(spark, d).where("seq <> ''"), branched_links(spark, d))
    return N.read_statistics(read_table(spark, d).withColumn("phred", F.lit("")), 2 * edges.count()).select(F.round("coverage", 9).alias("coverage"))


@query("SELECT item_id AS read_id, regexp_replace(upper(text), '[^ACGT]', '', 'g') AS seq FROM benchmark ORDER BY item_id LIMIT 10")
def head_reads(spark, d):
    """The first ten reads: the limit is the feature."""
    return first_reads(read_table(spark, d), 10)


@query(
    "WITH l AS (SELECT doc_id AS from_id, lead(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS to_id FROM documents QUALIFY to_id IS NOT NULL), "
    "m AS (SELECT doc_id AS from_id, lead(doc_id) OVER (PARTITION BY lang ORDER BY doc_id) AS to_id FROM documents QUALIFY to_id IS NOT NULL) SELECT from_id, count(*)::BIGINT AS n_links FROM (SELECT * FROM l UNION ALL SELECT * FROM m) GROUP BY 1"
)
def add_subgraph(spark, d):
    """Links that leave each segment after the graph by language is added to the one by source, appended ones included."""
    seg = sequences(spark, d)
    docs = _t(spark, d, "documents")
    by_lang = docs.select(F.col("doc_id").alias("from_id"), F.lead("doc_id").over(Window.partitionBy("lang").orderBy("doc_id")).alias("to_id")).where("to_id IS NOT NULL")
    by_lang = by_lang.select("from_id", F.lit(True).alias("from_fwd"), "to_id", F.lit(True).alias("to_fwd"), F.lit(0).alias("overlap"))
    both, links = G.add_subgraph(seg, link_table(spark, d), seg, by_lang)
    return links.join(both.select(F.col("seg_id").alias("from_id")), "from_id", "left_semi").groupBy("from_id").agg(F.count("*").alias("n_links"))


@query(f"WITH {DS} SELECT seg_id, -1 - (seg_id * 4294967296 + length(seq))::BIGINT AS node, true AS reverse, false AS in_trie, (seg_id * 4294967296 + length(seq))::BIGINT AS forward, length(seq)::BIGINT AS node_offset FROM ds")
def mirrored(spark, d):
    """The last node of every segment on the other strand, its region, and the way back."""
    node = S.mirror(S.node_id(F.col("seg_id"), F.length("seq")))
    at = sequences(spark, d).select("seg_id", node.alias("node"))
    return at.select("seg_id", "node", S.on_reverse(F.col("node")).alias("reverse"), (F.col("node") >= R.TRIE).alias("in_trie"), S.forward_node(F.col("node")).alias("forward"), S.node_offset(F.col("node")).alias("node_offset"))


@query(f"WITH {DS}, {GRAPH}, ends AS (SELECT from_id, to_id, right(seq, 1) AS label FROM bl JOIN seg ON from_id = seg_id) SELECT to_id AS seg_id, count(DISTINCT label)::BIGINT AS labels, count(*)::BIGINT AS n_in, count(*) = 1 AS single FROM ends GROUP BY 1")
def edges_into(spark, d):
    """Edges found by their ends: those of the branched graph that lead into each segment, and whether it is just one."""
    links = branched_links(spark, d)
    edges = G.link_edges(sequences(spark, d), links).join(sequences(spark, d).where("seq <> ''").select(S.node_id(F.col("seg_id"), F.lit(0)).alias("dst")), "dst", "left_semi")
    per = edges.groupBy(S.node_segment(F.col("dst")).alias("seg_id")).agg(F.count_distinct("label").alias("labels"), F.count("*").alias("n_in"))
    return per.withColumn("single", F.col("n_in") == 1)


@query("SELECT event_id, round(sum(CAST(round(value * 100) AS BIGINT)) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) / sum(CAST(round(value * 100) AS BIGINT)) OVER (), 9) AS share FROM events")
def cumsum_share(spark, d):
    """The running sum as a share of the whole."""
    cents = F.round(F.col("value") * 100).cast("long")
    out = W.running(_t(spark, d, "events").select("event_id", "value"), "event_id", [], cents)
    total = settled(out.agg(F.sum(cents).alias("total")))
    return out.crossJoin(F.broadcast(total)).select("event_id", F.round(F.col("running") / F.col("total"), 9).alias("share"))


@query(
    "WITH r AS (SELECT l_linenumber AS depth, l_partkey + 4 * l_suppkey AS total_edges, l_suppkey AS trie_edges FROM lineitem) "
    "SELECT depth, round(avg(total_edges - trie_edges), 6) AS reference, round(avg(trie_edges), 6) AS trie, round(avg(total_edges), 6) AS total FROM r GROUP BY 1"
)
def stacked_totals(spark, d):
    """Edges of the doubled graph and of the trie stacked on it, by depth, over rows that stand for runs."""
    runs = _t(spark, d, "lineitem").select(F.col("l_linenumber").alias("depth"), (F.col("l_partkey") + 4 * F.col("l_suppkey")).alias("total_edges"), F.col("l_suppkey").alias("trie_edges"))
    return N.stacked_edges(runs, "depth").select("depth", *[F.round(c, 6).alias(c) for c in ("reference", "trie", "total")])


@query(
    "SELECT measure, round(mean, 6) AS mean, highest::DOUBLE AS highest, label, unit FROM (SELECT 'head' AS measure, avg(l_partkey) AS mean, max(l_partkey)::DOUBLE AS highest, 'Reference size [bp]' AS label, 'bp' AS unit FROM lineitem "
    "UNION ALL SELECT 's', avg(l_extendedprice), max(l_extendedprice), 'Runtime [s]', 's' FROM lineitem UNION ALL SELECT 'N', avg(l_linenumber), max(l_linenumber), 'Reads', '' FROM lineitem "
    "UNION ALL SELECT 'cost', avg(l_quantity), max(l_quantity), 'Alignment cost', 'cost' FROM lineitem UNION ALL SELECT 'l_tax', avg(l_tax), max(l_tax), 'l_tax', 'l_tax' FROM lineitem)"
)
def column_labels(spark, d):
    """Columns of rows that stand for runs, with their means, their names on an axis and their units."""
    runs = _t(spark, d, "lineitem").select(F.col("l_partkey").alias("head"), F.col("l_extendedprice").alias("s"), F.col("l_linenumber").alias("N"), F.col("l_quantity").alias("cost"), "l_tax")
    return N.column_means(runs, runs.columns).withColumn("mean", F.round("mean", 6))
