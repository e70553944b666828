"""Queries of matching, grouping, quotes, catalogue and metrics over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyforge.functions import text as T
from tallyforge.operators import catalog, cluster, matching, metrics, quotes, setjoin
from tallyforge.operators import similarity as S
from tallyforge.operators.graph import saved
from tallyforge.plans.base import EQUIVALENTS, ITEMS, LINES, RECORDS, equivalents, items, lines, records, table
from tallyforge.sources import profile

QUERIES, ORACLES = {}, {}


def query(sql=None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


_EXACT = f"""WITH {RECORDS}, {ITEMS}, p AS (
  SELECT r.row_id, i.item_id, i.name, i.canonical_key, coalesce(i.folder_priority, 0) AS fp, i.folder_path LIKE '\\_%' ESCAPE '\\' AS side,
    (r.strength <> '' AND r.strength = i.strength)::INT + (r.coating <> '' AND r.coating = i.coating)::INT AS affinity,
    greatest(100 - CASE WHEN i.std_key = '' THEN 3 ELSE 0 END - CASE WHEN r.strength <> '' AND i.strength <> '' AND r.strength <> i.strength THEN 10 ELSE 0 END - CASE WHEN r.coating <> '' AND i.coating <> '' AND r.coating <> i.coating THEN 5 ELSE 0 END, 0) AS score
  FROM records r JOIN items i ON r.item_type = i.item_type AND upper(r.size) = i.size_norm WHERE i.is_active AND (i.std_key = '' OR i.std_key = r.std_key)),
k AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY row_id, canonical_key ORDER BY score DESC, fp DESC, side, affinity DESC, length(name), item_id) = 1),
t AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY score DESC, item_id) AS rank FROM k)"""


@query(_EXACT + " SELECT row_id, item_id, score::BIGINT AS score, CASE WHEN score >= 90 THEN 'AUTO_EXACT' ELSE 'SUGGESTED' END AS mode FROM t WHERE rank = 1")
def exact_match_top1(spark, d):
    e = matching.exact_candidates(records(spark, d), items(spark, d)).where("rank = 1")
    return e.select("row_id", "item_id", F.col("score").cast("long").alias("score"), F.when(F.col("score") >= 90, "AUTO_EXACT").otherwise("SUGGESTED").alias("mode"))


@query(_EXACT + " SELECT row_id, item_id, score::BIGINT AS score, rank::BIGINT AS rank FROM t WHERE rank <= 10")
def exact_match_top10(spark, d):
    return matching.exact_candidates(records(spark, d), items(spark, d)).select("row_id", "item_id", F.col("score").cast("long").alias("score"), F.col("rank").cast("long").alias("rank"))


_PRINT = "substr(sha1('item_type=' || item_type || '|size=' || lower(size) || '|diameter=' || lower(diameter) || '|length=' || length || '|din=' || lower(din) || CASE WHEN strength <> '' THEN '|strength=' || strength ELSE '' END || CASE WHEN coating <> '' THEN '|coating=' || coating ELSE '' END), 1, 16)"


@query(f"""WITH {RECORDS}, {ITEMS}, f AS (SELECT row_id, place, order_id, part_id, {_PRINT} AS fingerprint FROM records), m AS (SELECT fingerprint, arg_max(part_id, (order_id, part_id)) AS item_id FROM f WHERE place % 5 = 0 GROUP BY 1)
SELECT row_id, item_id FROM f JOIN m USING (fingerprint) JOIN items USING (item_id) WHERE is_active""")
def memory_match(spark, d):
    """Lines whose fingerprint a fifth of the lines confirmed: the latest order's item, if it is active."""
    fields = ("item_type", "size", "diameter", "length", "gost", "iso", "din", "strength", "coating")
    own = records(spark, d).withColumn("fingerprint", T.fingerprint({f: F.col(f) for f in fields}))
    memory = matching.remember(own.where("false").select("fingerprint", F.col("part_id").alias("item_id"), F.col("order_id").alias("confirmed_at")), own.where("place % 5 = 0").select("fingerprint", F.col("part_id").alias("item_id"), F.col("order_id").alias("confirmed_at")))
    return matching.memory_match(own, memory, items(spark, d))


_GRAMS = "list_distinct(list_transform(generate_series(1, greatest(length({t}) - 3, 1)), lambda i: substr({t}, i, 4)))"
_BENCH = f"""b AS (SELECT item_id AS a, replace(trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9. ]', ' ', 'g'), ' +', ' ', 'g')), ' ', '_') AS t FROM benchmark),
g AS (SELECT a, {_GRAMS.format(t='t')} AS g FROM b), x AS (SELECT a, len(g) AS n, unnest(g) AS w FROM g),
p AS (SELECT l.a, r.a AS b, count(*) AS c, any_value(l.n) AS ln, any_value(r.n) AS rn FROM x l JOIN x r ON l.w = r.w AND l.a <> r.a GROUP BY ALL)"""


def _bench(spark, d, name):
    return table(spark, d, "benchmark").select(F.col("item_id").alias(name), T.char_ngrams(F.trim(F.regexp_replace(F.regexp_replace(F.lower("text"), "[^a-z0-9. ]", " "), " +", " "))).alias("tokens"))


@query(f"WITH {_BENCH}, j AS (SELECT a, b, round(c / (ln + rn - c), 6) AS jaccard FROM p) SELECT a, b, jaccard, rank::BIGINT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY jaccard DESC, b) AS rank FROM j) WHERE rank <= 3")
def jaccard_topk(spark, d):
    j = setjoin.nearest_sets(_bench(spark, d, "a"), _bench(spark, d, "b"), "a", "b", 3, 1e-4, places=6, other=True)
    return j.select("a", "b", "jaccard", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_BENCH} SELECT a, b, c::BIGINT AS shared FROM p WHERE c / (ln + rn - c) >= 0.12")
def jaccard_pairs(spark, d):
    return S.token_join(_bench(spark, d, "a"), _bench(spark, d, "b"), "a", "b").where("a <> b AND jaccard >= 0.12").select("a", "b", F.col("shared").cast("long").alias("shared"))


@query(f"""WITH {ITEMS}, q AS (SELECT i.item_id AS row_id, j.item_id, i.size_norm AS row_size, j.size_norm AS item_size, i.std_key AS row_std, j.std_key AS item_std, i.item_type AS row_type, j.item_type AS item_type, 1.0 / (1 + abs(i.item_id - j.item_id)) AS jaccard
  FROM items i JOIN items j ON j.item_id BETWEEN i.item_id + 1 AND i.item_id + 12),
s AS (SELECT *, row_size = item_size OR (abs(a[1] - b[1]) <= 0.02 * greatest(a[1], b[1]) AND abs(a[2] - b[2]) <= 0.02 * greatest(a[2], b[2])) AS z, row_std = '' OR item_std = '' OR row_std = item_std AS n, row_type = item_type AS t
  FROM (SELECT *, list_sort(list_transform(regexp_extract_all(row_size, '[0-9]+'), lambda v: v::DOUBLE)) AS a, list_sort(list_transform(regexp_extract_all(item_size, '[0-9]+'), lambda v: v::DOUBLE)) AS b FROM q)),
c AS (SELECT *, max(z AND n AND t) OVER w AS c0, max(z AND t) OVER w AS c1, max(z) OVER w AS c2 FROM s WINDOW w AS (PARTITION BY row_id))
SELECT row_id, item_id, CASE WHEN c0 THEN 0 WHEN c1 THEN 1 ELSE 2 END::BIGINT AS level FROM c WHERE CASE WHEN c0 THEN z AND n AND t WHEN c1 THEN z AND t WHEN c2 THEN z ELSE false END""")
def post_filter_ladder(spark, d):
    i = items(spark, d).select(F.col("item_id").alias("row_id"), F.col("size_norm").alias("row_size"), F.col("std_key").alias("row_std"), F.col("type_norm").alias("row_type"), F.explode(F.sequence(F.col("item_id") + 1, F.col("item_id") + 12)).alias("item_id"))
    j = items(spark, d).select("item_id", F.col("size_norm").alias("item_size"), F.col("std_key").alias("item_std"), F.col("type_norm").alias("item_type"))
    pairs = i.join(j, "item_id").withColumn("jaccard", 1.0 / (1 + F.abs(F.col("row_id") - F.col("item_id"))))
    return matching.filter_ladder(matching.badges(pairs)).select("row_id", "item_id", F.col("filter_level").cast("long").alias("level"))


@query(f"""WITH {RECORDS}, {ITEMS}, p AS (SELECT r.*, i.item_type AS it, i.size AS isz, i.std_key AS ik, i.strength AS ist, i.coating AS ico, i.folder_priority AS fp, regexp_extract_all(r.size, '[0-9]+') AS ra, regexp_extract_all(i.size, '[0-9]+') AS ia FROM records r JOIN items i ON r.part_id = i.item_id),
f AS (SELECT *, CASE WHEN list_sort(list_transform(ra, lambda v: v::INT)) = list_sort(list_transform(ia, lambda v: v::INT)) THEN 1.0 WHEN len(list_filter(list_zip(list_sort(list_transform(ra, lambda v: v::INT)), list_sort(list_transform(ia, lambda v: v::INT))), lambda z: abs(z[1] - z[2]) > 0.02 * greatest(z[1], z[2]))) = 0 THEN 0.85 WHEN ia[1]::INT > 0 THEN 0.60 ELSE 0.0 END AS fs,
    CASE WHEN ik = std_key THEN 1.0 WHEN ik <> '' THEN 0.30 ELSE 0.0 END AS fd, CASE WHEN strength <> '' AND strength = ist THEN 0.15 ELSE 0.0 END + CASE WHEN coating <> '' AND coating = ico THEN 0.15 ELSE 0.0 END + 0.15 AS fx FROM p)
SELECT row_id, least(100, least(100, greatest(0, round_even((40 + 35 * fs + 20 * fd + 5 * fx) / 100 * 100, 0))) + CASE fp WHEN 1 THEN 8 WHEN 2 THEN 4 WHEN 3 THEN 2 WHEN 4 THEN 1 ELSE 0 END)::BIGINT AS score FROM f""")
def weighted_score(spark, d):
    r = records(spark, d).select("row_id", F.col("part_id").alias("item_id"), F.col("item_type").alias("r_type"), F.col("size").alias("r_size"), F.col("std_key").alias("r_key"), F.col("strength").alias("r_strength"), F.col("coating").alias("r_coating"), F.col("raw_text").alias("r_text"))
    i = items(spark, d).select("item_id", F.col("item_type").alias("i_type"), F.col("size").alias("i_size"), F.col("std_key").alias("i_key"), F.col("strength").alias("i_strength"), F.col("coating").alias("i_coating"), F.col("name").alias("i_text"), "folder_priority")
    return matching.weighted_score(matching.score_features(r, "r").join(matching.score_features(i, "i"), "item_id")).select("row_id", F.col("score").cast("long").alias("score"))


_DECIDE = _EXACT + ", m AS (SELECT row_id, item_id FROM records JOIN items ON part_id = item_id WHERE is_active AND part_id % 4 = 0)"


@query(_DECIDE + """ SELECT r.row_id, CASE WHEN m.item_id IS NOT NULL THEN 'AUTO_MEMORY' WHEN t.score >= 90 THEN 'AUTO_EXACT' WHEN t.score IS NOT NULL THEN 'SUGGESTED' ELSE 'NONE' END AS mode,
  coalesce(m.item_id, t.item_id) AS item_id FROM records r LEFT JOIN m USING (row_id) LEFT JOIN (SELECT * FROM t WHERE rank = 1) t USING (row_id)""")
def match_without_similarity(spark, d):
    """Decisions on all lines by memory and exact fields alone, with the similarity stage off."""
    own = records(spark, d).withColumn("fingerprint", F.concat(F.lit("f"), F.col("part_id").cast("string")))
    memory = items(spark, d).where("item_id % 4 = 0").select(F.concat(F.lit("f"), F.col("item_id").cast("string")).alias("fingerprint"), "item_id", F.lit(1).alias("confirmed_at"))
    return matching.decide(own, items(spark, d), matching.Settings(similar=False), memory=memory).select("row_id", "mode", "item_id")


@query()
def minhash_signatures(spark, d):
    """Signatures of 128 permutations of the catalogue's 4-grams."""
    i = items(spark, d).withColumn("tokens", T.char_ngrams(T.similarity_text(F.concat_ws(" ", "name", "size"))))
    return S.signatures(i, ["item_id"])


@query(f"""WITH {ITEMS}, g AS (SELECT item_id, list_distinct(list_transform(generate_series(1, greatest(length(t) - 3, 1)), lambda i: substr(t, i, 4))) AS g FROM (SELECT item_id, replace(name, ' ', '_') AS t FROM items)),
x AS (SELECT item_id, unnest(g) AS w FROM g), h AS (SELECT item_id, k, min(substr(sha1(k || ':' || w), 1, 8)) AS m FROM x, unnest(generate_series(0, 15)) AS s(k) GROUP BY ALL)
SELECT item_id, string_agg(m, '' ORDER BY k) AS signature FROM h GROUP BY item_id""")
def text_signatures(spark, d):
    """Signatures by smallest digests, the same on any engine."""
    return items(spark, d).select("item_id", S.digest_signature(T.char_ngrams(F.col("name")), 16).alias("signature"))


_KEYED = f"""{ITEMS}, k AS (SELECT *, name AS name_key FROM items WHERE is_active),
dup AS (SELECT a.item_id AS a, b.item_id AS b FROM k a JOIN k b ON a.item_type = b.item_type AND a.size_key = b.size_key AND a.name_key = b.name_key AND a.item_id < b.item_id AND (a.std_key = '' OR b.std_key = '' OR a.std_key = b.std_key)),
ana AS (SELECT a.item_id AS a, b.item_id AS b, a.std_key AS s, b.std_key AS s2, a.item_type AS ty, a.size_key AS sz FROM k a JOIN eq ON eq.a = a.std_key JOIN k b ON b.std_key = eq.b AND a.item_type = b.item_type AND a.size_key = b.size_key AND a.item_id < b.item_id)"""
_COMPONENTS = """, e AS (SELECT a, b FROM dup UNION SELECT b, a FROM dup UNION SELECT a, b FROM ana UNION SELECT b, a FROM ana),
r AS (SELECT item_id AS id, item_id AS top FROM k UNION SELECT e.b, r.top FROM r JOIN e ON e.a = r.id WHERE r.top < e.b),
c AS (SELECT id AS item_id, min(top) AS group_id FROM r GROUP BY id), g AS (SELECT *, count(*) OVER (PARTITION BY group_id) AS group_size FROM c)"""


@query(f"WITH {EQUIVALENTS}, {_KEYED} SELECT a, b FROM dup")
def dup_pairs(spark, d):
    return cluster.duplicate_pairs(items(spark, d)).select("a", "b")


@query(f"WITH {EQUIVALENTS}, {_KEYED} SELECT a, b, s || ' ↔ ' || s2 || ' | ' || ty || ' | ' || sz AS detail FROM ana")
def analog_pairs(spark, d):
    return cluster.analog_pairs(items(spark, d), equivalents(spark)).select("a", "b", "detail")


def _groups(spark, d):
    i = items(spark, d)
    return i, cluster.groups(i, cluster.duplicate_links(i).unionByName(cluster.analog_links(i, equivalents(spark))))


@query(f"WITH RECURSIVE {EQUIVALENTS}, {_KEYED}{_COMPONENTS} SELECT item_id, group_id, group_size::BIGINT AS group_size FROM g WHERE group_size > 1")
def dup_groups(spark, d):
    return _groups(spark, d)[1].select("item_id", "group_id", F.col("group_size").cast("long").alias("group_size"))


@query(f"WITH RECURSIVE {EQUIVALENTS}, {_KEYED}{_COMPONENTS} SELECT item_id, group_id, group_size::BIGINT AS group_size FROM g WHERE group_size > 1")
def groups_after_sync(spark, d):
    """The same groups, from those of an earlier catalogue: of its items some went, some came, some had another name or standard."""
    after, eq = saved(items(spark, d)), equivalents(spark)
    k = F.col("item_id") % 50
    before = after.where(k != 9).withColumns({"name": F.when(k == 3, "small ring").otherwise(F.col("name")), "standard_key": F.when(k == 21, "DIN-931").otherwise(F.col("standard_key"))})
    before = saved(before.unionByName(after.where(k == 9).withColumns({"item_id": -F.col("item_id") - 1})))
    old = saved(cluster.groups(before, cluster.all_links(before, eq)))
    return cluster.groups_after(old, before, after, eq).select("item_id", "group_id", F.col("group_size").cast("long").alias("group_size"))


@query(f"""WITH RECURSIVE {EQUIVALENTS}, {_KEYED}{_COMPONENTS}, m AS (SELECT g.*, k.name, k.uid_1c, k.folder_priority, k.folder_path FROM g JOIN k USING (item_id) WHERE group_size > 1)
SELECT group_id, item_id, CASE WHEN row_number() OVER (PARTITION BY group_id ORDER BY coalesce(folder_priority, 999999), folder_path LIKE '\\_%' ESCAPE '\\', length(name), uid_1c, item_id) = 1 THEN 'parent' ELSE 'child' END AS role FROM m""")
def parent_election(spark, d):
    i, g = _groups(spark, d)
    return cluster.elect_parent(g, i).select("group_id", "item_id", "role")


@query(f"""WITH RECURSIVE {EQUIVALENTS}, {_KEYED}{_COMPONENTS}, m AS (SELECT g.*, k.name, k.uid_1c, k.folder_priority, k.folder_path FROM g JOIN k USING (item_id) WHERE group_size > 1),
o AS (SELECT *, first_value(lower(name)) OVER (PARTITION BY group_id ORDER BY coalesce(folder_priority, 999999), folder_path LIKE '\\_%' ESCAPE '\\', length(name), uid_1c, item_id) AS pn FROM m)
SELECT item_id, dense_rank() OVER (ORDER BY group_size DESC, pn, group_id)::BIGINT AS group_num FROM o""")
def group_export(spark, d):
    i, g = _groups(spark, d)
    return cluster.group_report(cluster.elect_parent(g, i)).select("item_id", F.col("group_num").cast("long").alias("group_num"))


# Orders take a third of the lines as their items; suppliers quote the rest.


def _order(spark, d):
    r = records(spark, d)
    order_items = r.where("place % 3 = 0").select("order_id", F.col("row_id").alias("item_id"), "type_norm", "size_norm", F.col("std_key").alias("std_norm"), F.col("raw_text").alias("name"))
    ql = r.where("place % 3 <> 0").select("order_id", F.concat_ws("-", F.col("order_id").cast("string"), (F.col("supplier_id") % 2).cast("string")).alias("quote_id"), F.col("row_id").alias("line_id"), "type_norm", F.regexp_replace("size_norm", "X.*", "").alias("z"), F.col("std_key").alias("std_norm"), "price", F.lit(1.0).alias("qty"), F.lit("шт").alias("unit"), F.when(F.col("place") % 11 == 0, "total").otherwise("item").alias("line_class"), (F.col("supplier_id") % 2).alias("supplier_id"), F.col("raw_text").alias("name"))
    return order_items.withColumn("size_norm", F.regexp_replace("size_norm", "X.*", "")), ql.withColumnRenamed("z", "size_norm")


_QUOTES = f"""{RECORDS}, oi AS (SELECT order_id, row_id AS item_id, item_type, diameter AS z, std_key FROM records WHERE place % 3 = 0),
ql AS (SELECT order_id, order_id || '-' || (supplier_id % 2) AS quote_id, row_id AS line_id, item_type, diameter AS z, std_key, price, CASE WHEN place % 11 = 0 THEN 'total' ELSE 'item' END AS line_class, supplier_id % 2 AS supplier_id FROM records WHERE place % 3 <> 0),
ex AS (SELECT ql.order_id, ql.quote_id, line_id, item_id, 100 - CASE WHEN ql.std_key = oi.std_key THEN 0 WHEN (ql.std_key, oi.std_key) IN (('DIN-931', 'DIN-933'), ('DIN-933', 'DIN-931')) THEN 5 ELSE 20 END AS score
  FROM ql JOIN oi ON ql.order_id = oi.order_id AND ql.item_type = oi.item_type AND ql.z = oi.z WHERE line_class = 'item'),
best AS (SELECT * FROM ex QUALIFY row_number() OVER (PARTITION BY line_id ORDER BY score DESC, item_id) = 1)"""


@query(f"WITH {_QUOTES} SELECT line_id, item_id, score::BIGINT AS score FROM ex")
def quote_match(spark, d):
    oi, ql = _order(spark, d)
    return quotes.exact_pairs(ql, oi, equivalents(spark)).select("line_id", "item_id", F.col("score").cast("long").alias("score"))


@query(f"WITH {_BENCH}, j AS (SELECT a, round(c / (ln + rn - c), 6) AS jaccard, b FROM p) SELECT a, round(jaccard - coalesce(lead(jaccard) OVER w, 0), 6) AS delta FROM j WINDOW w AS (PARTITION BY a ORDER BY jaccard DESC, b) QUALIFY row_number() OVER w = 1")
def best_vs_second_delta(spark, d):
    j = S.token_join(_bench(spark, d, "a"), _bench(spark, d, "b"), "a", "b").where("a <> b").withColumn("jaccard", F.round("jaccard", 6))
    w = Window.partitionBy("a").orderBy(F.desc("jaccard"), "b")
    out = S.top_k(j.withColumn("second", F.lead("jaccard").over(w)), "a", [F.desc("jaccard"), F.col("b")], 1)
    return out.select("a", F.round(F.col("jaccard") - F.coalesce("second", F.lit(0.0)), 6).alias("delta"))


@query(f"WITH {RECORDS}, s AS (SELECT CASE WHEN strength = '' THEN 'manual' WHEN coating = '' THEN 'review' ELSE 'ok' END AS status FROM records) SELECT count(*) FILTER (WHERE status = 'ok')::BIGINT AS ok, count(*) FILTER (WHERE status = 'review')::BIGINT AS review, count(*) FILTER (WHERE status = 'manual')::BIGINT AS manual, count(*)::BIGINT AS total, round_even(100.0 * count(*) FILTER (WHERE status = 'ok') / count(*), 0)::BIGINT AS ok_pct FROM s")
def status_counts(spark, d):
    r = records(spark, d).select(F.when(F.col("strength") == "", "manual").when(F.col("coating") == "", "review").otherwise("ok").alias("status"))
    c = metrics.status_counts(r)
    return c.select("ok", "review", "manual", "total", F.col("ok_pct").cast("long").alias("ok_pct"))


@query(f"WITH {RECORDS}, s AS (SELECT item_type, ['AUTO_MEMORY', 'AUTO_EXACT', 'SUGGESTED', 'NONE'][(place % 4 + 1)::INT] AS mode FROM records) SELECT count(*)::BIGINT AS total, count(*) FILTER (WHERE mode = 'AUTO_MEMORY')::BIGINT AS auto, count(*) FILTER (WHERE mode = 'SUGGESTED')::BIGINT AS suggested, count(*) FILTER (WHERE mode IN ('AUTO_EXACT', 'NONE'))::BIGINT AS not_matched, count(*) FILTER (WHERE item_type <> '')::BIGINT AS recognised FROM s")
def match_summary(spark, d):
    modes = F.array(*[F.lit(m) for m in ("AUTO_MEMORY", "AUTO_EXACT", "SUGGESTED", "NONE")])
    return metrics.match_summary(records(spark, d).select("item_type", F.get(modes, (F.col("place") % 4).cast("int")).alias("mode")))


@query(r"SELECT regexp_extract(trim(lower(coalesce(text, ''))), '^\S+') AS word, count(*)::BIGINT AS n FROM documents WHERE regexp_extract(trim(lower(coalesce(text, ''))), '^\S+') <> '' GROUP BY 1 ORDER BY n DESC, word LIMIT 15")
def top_unknown_words(spark, d):
    return metrics.top_unknown_words(table(spark, d, "documents").select(F.col("text").alias("name"), F.lit("").alias("item_type")))


@query("SELECT o_orderkey AS order_id, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey)::BIGINT AS n_lines, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber = 1)::BIGINT AS n_items, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber > 4)::BIGINT AS n_quotes FROM orders")
def order_line_counts(spark, d):
    l = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("order_id"), "l_linenumber")
    return metrics.order_counts(table(spark, d, "orders").select(F.col("o_orderkey").alias("order_id")), l, l.where("l_linenumber = 1"), l.where("l_linenumber > 4"))


_RUNS = "r AS (SELECT o_orderkey AS id, o_orderdate AS created_at, o_orderkey % 40 + 1 AS total_client_lines, o_orderkey % 20 AS parsed_client_lines, o_orderkey % 10 AS auto_matches, o_orderkey % 5 AS manual_matches, o_orderkey % 7 AS system_match_correct, o_orderkey % 3 AS system_match_incorrect FROM orders ORDER BY created_at DESC, id DESC LIMIT 50)"


def _runs(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(k.alias("id"), F.col("o_orderdate").alias("created_at"), (k % 40 + 1).alias("total_client_lines"), (k % 20).alias("parsed_client_lines"), (k % 10).alias("auto_matches"), (k % 5).alias("manual_matches"), (k % 7).alias("system_match_correct"), (k % 3).alias("system_match_incorrect"))


@query(f"WITH {_RUNS} SELECT count(*)::BIGINT AS total_runs, sum(total_client_lines)::BIGINT AS total_client_lines, round_even(sum(parsed_client_lines) / sum(total_client_lines)::DOUBLE, 4) AS parse_success_rate, round_even(sum(auto_matches) / sum(total_client_lines)::DOUBLE, 4) AS auto_match_rate, round_even(sum(manual_matches) / sum(total_client_lines)::DOUBLE, 4) AS manual_match_rate, round_even(sum(system_match_correct) / sum(system_match_correct + system_match_incorrect)::DOUBLE, 4) AS match_accuracy, round_even(sum(auto_matches) / sum(total_client_lines)::DOUBLE, 4) AS full_auto_rate FROM r")
def quality_metrics_last_n(spark, d):
    return metrics.quality(_runs(spark, d))


@query("SELECT count(*)::BIGINT AS n, round(avg(coalesce((props->>'k')::DOUBLE, 0)), 4) AS k, 0.0::DOUBLE AS missing FROM events WHERE event_type = 'click' AND props IS NOT NULL")
def step_json_avg(spark, d):
    return metrics.step_means(table(spark, d, "events"), ["k", "missing"], "click", "props", "event_type")


@query(f"WITH {RECORDS} SELECT round_even(sum(5 + (strength <> '')::INT + (coating <> '')::INT) / (count(*) * 9.0), 4)::DOUBLE AS field_recognition_rate, 1.0::DOUBLE AS size_recognition_rate, round_even(avg((strength <> '')::INT), 4) AS strength_recognition_rate, round_even(avg((coating <> '')::INT), 4) AS coating_recognition_rate, 1.0::DOUBLE AS standard_recognition_rate FROM records")
def field_recognition(spark, d):
    return metrics.recognition(records(spark, d))


def _expected(spark, d):
    k = F.col("part_id")
    return records(spark, d).select(
        "row_id", F.when(F.col("place") % 2 == 0, "client").otherwise("supplier").alias("source_type"), F.col("item_type").alias("got_type"), F.when(k % 5 > 0, F.when(k % 3 == 0, F.upper("item_type")).otherwise("bolt")).alias("expected_type"),
        F.col("strength").alias("got_strength"), F.when(k % 2 == 0, "8.8").otherwise("").alias("expected_strength"),
    )


_EXPECTED = RECORDS + """, x AS (SELECT CASE WHEN place % 2 = 0 THEN 'client' ELSE 'supplier' END AS source_type, CASE WHEN part_id % 5 > 0 THEN CASE WHEN part_id % 3 = 0 THEN true ELSE item_type = 'bolt' END END AS t, CASE WHEN part_id % 2 = 0 THEN strength = '8.8' END AS s FROM records)"""


@query(f"WITH {_EXPECTED} SELECT source_type, (count(t) + count(s))::BIGINT AS checks, (count(*) FILTER (WHERE t) + count(*) FILTER (WHERE s))::BIGINT AS correct, round_even((count(*) FILTER (WHERE t) + count(*) FILTER (WHERE s)) / (count(t) + count(s))::DOUBLE, 4) AS accuracy FROM x GROUP BY 1")
def eval_accuracy(spark, d):
    return metrics.evaluation(_expected(spark, d), ["type", "strength"])


@query(f"WITH {_EXPECTED}, y AS (SELECT 'type' AS field, t AS ok FROM x UNION ALL SELECT 'strength', s FROM x) SELECT field, count(ok)::BIGINT AS checks, count(*) FILTER (WHERE ok)::BIGINT AS correct, count(*) FILTER (WHERE NOT ok)::BIGINT AS errors FROM y GROUP BY 1")
def eval_field_stats(spark, d):
    return metrics.field_stats(_expected(spark, d), ["type", "strength"])


def _grid(spark, d):
    """Every line as a row of a grid: a rising number, the text, a digit and a code."""
    return lines(spark, d).select(F.col("place").alias("row_index"), F.array(F.col("place").cast("string"), "raw_text", (F.col("part_id") % 9).cast("string"), F.concat(F.lit("A-"), F.col("part_id").cast("string"))).alias("cells"))


_GRID = LINES + ", g AS (SELECT place AS i, raw_text, (part_id % 9)::VARCHAR AS q, 'A-' || part_id AS c FROM lines)"


@query(f"""WITH {_GRID}, v AS (SELECT 0 AS col, i::VARCHAR AS v FROM g UNION ALL SELECT 1, raw_text FROM g UNION ALL SELECT 2, q FROM g UNION ALL SELECT 3, c FROM g)
SELECT col::BIGINT AS col, count(*)::BIGINT AS n, round(avg(length(v)), 6) AS avg_len, round(avg(regexp_matches(v, '[a-zA-Z]')::INT), 6) AS alpha, round(avg(regexp_matches(v, '^\\s*\\d+([.,\\s]\\d+)?\\s*$')::INT), 6) AS number, count(try_cast(v AS DOUBLE))::BIGINT AS numbers FROM v GROUP BY 1""")
def column_profile(spark, d):
    f = profile.column_features(_grid(spark, d))
    return f.select(F.col("col").cast("long").alias("col"), "n", F.round("avg_len", 6).alias("avg_len"), F.round("alpha", 6).alias("alpha"), F.round("number", 6).alias("number"), "numbers")


@query(f"""WITH {_GRID}, v AS (SELECT 0 AS col, i, i::VARCHAR AS v FROM g UNION ALL SELECT 1, i, raw_text FROM g UNION ALL SELECT 2, i, q FROM g UNION ALL SELECT 3, i, c FROM g),
x AS (SELECT col, v, try_cast(v AS DOUBLE) AS x, lag(try_cast(v AS DOUBLE)) OVER (PARTITION BY col ORDER BY i) AS b FROM v)
SELECT col::BIGINT AS col, NOT bool_or(regexp_matches(v, '[a-zA-Z]')) AND count(x) >= 2 AND count(x) >= 0.8 * count(*) AND count(*) FILTER (WHERE x <= b) <= 0.1 * (count(x) - 1) AS is_index FROM x GROUP BY 1""")
def index_column(spark, d):
    return profile.index_columns(_grid(spark, d)).select(F.col("col").cast("long").alias("col"), "is_index")


def _feed(spark, d):
    k = F.col("p_partkey")
    old = table(spark, d, "part").where("p_partkey % 5 <> 0").select(F.concat(F.lit("u"), k.cast("string")).alias("uid"), F.lit(None).cast("string").alias("char"), F.col("p_name").alias("name"), (k % 7 != 0).alias("is_active"))
    new = table(spark, d, "part").where("p_partkey % 3 <> 0").select(F.concat(F.lit("u"), k.cast("string")).alias("uid"), F.lit(None).cast("string").alias("char"), F.when(k % 4 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("name"))
    return old, new


_SYNC = """s AS (SELECT 'u' || p_partkey AS uid, p_partkey % 5 <> 0 AS o, p_partkey % 3 <> 0 AS n, p_partkey % 7 <> 0 AS act, p_partkey % 4 = 0 AS up, p_name FROM part),
x AS (SELECT uid, CASE WHEN n AND NOT o THEN 'created' WHEN n AND (up OR NOT act) THEN 'updated' WHEN n THEN 'unchanged' WHEN act THEN 'deactivated' ELSE 'inactive' END AS action, CASE WHEN n AND up THEN upper(p_name) ELSE p_name END AS name, n AS is_active FROM s WHERE o OR n)"""


@query(f"WITH {_SYNC} SELECT uid, action, name, is_active FROM x")
def upsert_classify(spark, d):
    old, new = _feed(spark, d)
    return catalog.sync(old, new).select("uid", "action", "name", "is_active")


@query(f"WITH {_SYNC} SELECT uid FROM x WHERE action = 'deactivated'")
def soft_delete(spark, d):
    old, new = _feed(spark, d)
    return catalog.sync(old, new).where("action = 'deactivated'").select("uid")


def _folders(spark, d):
    r = table(spark, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("folder_uid"), F.col("r_name").alias("folder_name"), F.lit("").alias("parent_uid"), F.when(F.col("r_regionkey") % 2 == 0, F.col("r_regionkey").cast("int")).alias("priority"))
    n = table(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")), F.col("n_name"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")), F.when(F.col("n_nationkey") % 3 == 0, F.col("n_nationkey").cast("int")))
    s = table(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")), F.col("s_name"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")), F.lit(None).cast("int"))
    return r.union(n).union(s)


@query("""SELECT 'r' || r_regionkey AS folder_uid, r_name AS path, CASE WHEN r_regionkey % 2 = 0 THEN r_regionkey END::BIGINT AS priority FROM region
UNION ALL SELECT 'n' || n_nationkey, r_name || ' / ' || n_name, coalesce(CASE WHEN n_nationkey % 3 = 0 THEN n_nationkey END, CASE WHEN r_regionkey % 2 = 0 THEN r_regionkey END) FROM nation JOIN region ON r_regionkey = n_regionkey
UNION ALL SELECT 's' || s_suppkey, r_name || ' / ' || n_name || ' / ' || s_name, coalesce(CASE WHEN n_nationkey % 3 = 0 THEN n_nationkey END, CASE WHEN r_regionkey % 2 = 0 THEN r_regionkey END) FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey""")
def folder_path(spark, d):
    return catalog.folder_paths(_folders(spark, d)).select("folder_uid", "path", F.col("priority").cast("long").alias("priority"))


@query("SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%RING%' OR p_brand ILIKE '%ring%' ORDER BY p_name, p_partkey LIMIT 20")
def catalog_search(spark, d):
    return catalog.search(table(spark, d, "part"), "RING", ["p_name", "p_brand"], ["p_name", "p_partkey"]).select("p_partkey", "p_name")
