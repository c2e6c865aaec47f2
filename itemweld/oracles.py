"""DuckDB SQL for every registered query whose result is unique, built from shared
CTEs over the sales tables. Written independently of the Spark plans: pairs come
from comparing whole blocks, components from a recursive CTE."""

import re
from functools import cache

from itemweld import oracle_generator, registry
from itemweld.operators.evaluation import AUTO_PRECISION, LEAST_LABELS, REVIEW_RECALL
from itemweld.operators.neighbors import LSH_TABLES, lsh_width
from itemweld.plans.workspace import WIDE_DISTANCE
from itemweld.schema import FEATURES, GRID_CELL, GRID_COUNT, MATCH_DISTANCE, REVIEW_STATUSES
from itemweld.sources import orders_catalog as OC

_ACTIVE = ["weight", "length", "width", "thickness", "hole_count"]   # features with spread
_NAMED = _ACTIVE + ["conductor_count"]
_CATEGORY_STATUS = ", ".join(f"'{s}'" for s in REVIEW_STATUSES)


def _jitter(column):
    i = OC.JITTERED.index(column)

    def times(s):
        return (f"{column} * (1 + (((k * {OC.JITTER_MULTIPLY[s][i]} + {OC.JITTER_ADD[i]}) % 41) - 20) / 20000::DOUBLE)")
    hard = {"width": " WHEN suffix = 'H' AND part_category <> 'SMALL' THEN width * 1.5::DOUBLE",
            "thickness": " WHEN suffix = 'H' AND part_category = 'SMALL' THEN thickness * 1.5::DOUBLE"}
    return (f"CASE WHEN suffix = 'D' THEN {times('D')} WHEN suffix = 'E' THEN {times('E')}"
            f"{hard.get(column, '')} ELSE {column} END AS {column}")


def _distance(x="x", y="y"):
    return "sqrt(" + " + ".join(f"({x}.z_{f} - {y}.z_{f}) * ({x}.z_{f} - {y}.z_{f})" for f in _ACTIVE) + ")"


def _same_grid(i):
    shift, cell = f"{GRID_CELL * i / GRID_COUNT!r}::DOUBLE", f"{GRID_CELL!r}::DOUBLE"
    return " AND ".join(
        f"floor((x.z_{f} + {shift}) / {cell}) = floor((y.z_{f} + {shift}) / {cell})" for f in _ACTIVE)


def _round(expression, digits, alias=None):
    """Half-up on the decimal text, after the noise of summation order is dropped;
    the counterpart of `registry.rounded`."""
    text = f"CAST(round({expression}, {digits + 5}) AS VARCHAR)"
    return f"CAST(CAST({text} AS DECIMAL(28, {digits})) AS DOUBLE) + 0.0 AS {alias or expression}"


_SUM_COLUMNS = (f"{_round('avg_similarity', 6)}, group_best_price, "
                f"{_round('total_current_spend', 4)}, {_round('savings_potential', 4)}")
_GROUP_COLUMNS = ("group_id, part_category, material, member_count, models_spanned, machine_types_spanned, "
                  f"plants_spanned, {_SUM_COLUMNS}")
_QUEUE_COLUMNS = f"{_GROUP_COLUMNS}, status, normalized, enterprise_part_number"
_NET = "price_per_unit * (1 - coalesce(unit_discount, 0))"

CTES = {
    # catalogue
    "lines": """SELECT l_partkey, avg(l_quantity) AS q, round(sum(l_extendedprice), 2) / count(*) AS e,
        count(*) AS c, sum(l_quantity) AS vol FROM lineitem GROUP BY 1""",
    "base": """SELECT p_partkey AS k, p_partkey % 25 AS m, CAST(p_partkey AS VARCHAR) AS part_id,
        p_brand || '-' || CAST(p_partkey % 200 AS VARCHAR) AS part_number, p_type AS part_category,
        'M' || CAST(p_partkey % 3 AS VARCHAR) AS material, CAST(p_size AS DOUBLE) AS length,
        p_retailprice AS weight, CASE WHEN p_type <> 'SMALL' THEN q END AS width,
        CASE WHEN p_partkey % 37 <> 0 THEN e END AS thickness, CAST(c AS INTEGER) AS hole_count,
        CASE WHEN p_type = 'ECONOMY' THEN 1 END AS conductor_count, CAST(vol AS INTEGER) AS annual_volume
        FROM part LEFT JOIN lines ON l_partkey = p_partkey""",
    "suffixed": """SELECT *, 'D' AS suffix FROM base WHERE k % 20 = 0 UNION ALL
        SELECT *, 'E' FROM base WHERE k % 60 = 0 UNION ALL SELECT *, 'H' FROM base WHERE k % 50 = 7
        UNION ALL SELECT *, 'N' FROM base WHERE k % 100 = 11""",
    "keyed_parts": f"""SELECT k, m, part_id, part_number, part_category, material, length, weight, width, thickness,
        hole_count, conductor_count, annual_volume FROM base UNION ALL
        SELECT k, CASE suffix WHEN 'D' THEN (m + 1 + (k * 7) % 24) % 25 WHEN 'E' THEN (m + 5) % 25 ELSE m END,
        part_id || '-' || suffix, part_number, part_category, CASE suffix WHEN 'N' THEN material || 'x' ELSE material END,
        {_jitter('length')}, {_jitter('weight')}, {_jitter('width')}, {_jitter('thickness')},
        hole_count, conductor_count,
        CAST(CASE suffix WHEN 'D' THEN 5 + (k * 31) % 395 WHEN 'E' THEN 5 + (k * 37) % 395 ELSE annual_volume END AS INTEGER)
        FROM suffixed""",
    "parts": """SELECT *, CAST(m AS VARCHAR) AS model_id,
        material || ' ' || part_category || ', PN ' || part_number AS description FROM keyed_parts""",
    "models": """SELECT CAST(n_nationkey AS VARCHAR) AS model_id, CAST(n_regionkey AS VARCHAR) AS plant_id,
        CASE WHEN n_nationkey % 2 = 0 THEN 'Harvester' ELSE 'Tractor' END AS machine_type FROM nation""",
    "vendors": "SELECT CAST(s_suppkey AS VARCHAR) AS supplier_id, s_name AS supplier_name FROM supplier",
    "base_offers": """SELECT l_partkey AS k, l_suppkey AS s, min(l_extendedprice / l_quantity) AS price_per_unit,
        max(l_discount) AS unit_discount, CAST(7 * (1 + (l_partkey + l_suppkey) % 6) AS INTEGER) AS lead_time_days,
        substr('ABC', CAST((l_partkey + 2 * l_suppkey) % 3 + 1 AS INTEGER), 1) AS material_quality_grade
        FROM lineitem GROUP BY l_partkey, l_suppkey""",
    "offers": """SELECT CAST(s AS VARCHAR) AS supplier_id, CAST(k AS VARCHAR) AS part_id, price_per_unit, unit_discount,
        lead_time_days, 'USD' AS currency, material_quality_grade FROM base_offers UNION ALL
        SELECT CAST(o.s AS VARCHAR), p.part_id,
        o.price_per_unit * (0.8::DOUBLE + ((o.k * 19 + o.s * 7) % 41) / 100::DOUBLE),
        o.unit_discount, o.lead_time_days, 'USD', o.material_quality_grade
        FROM base_offers o JOIN parts p ON p.k = o.k AND contains(p.part_id, '-')
        JOIN nation pn ON pn.n_nationkey = p.m
        JOIN supplier ON s_suppkey = o.s AND s_acctbal > 5000
        JOIN nation sn ON sn.n_nationkey = s_nationkey AND sn.n_regionkey = pn.n_regionkey""",
    "truth": """SELECT substr(part_id, 1, length(part_id) - 2) AS base_part_id, part_id AS variant_part_id,
        CASE right(part_id, 1) WHEN 'H' THEN 'hard_negative' WHEN 'N' THEN 'near_miss' ELSE 'duplicate' END AS relationship,
        part_category FROM parts WHERE regexp_matches(part_id, '-[DEHN]$')""",
    # features
    "stats": " UNION ALL ".join(
        f"""SELECT part_category, '{f}' AS feature, avg({f}::DOUBLE) AS mean, stddev_pop({f}::DOUBLE) AS std
        FROM parts WHERE NOT contains(part_id, '-') GROUP BY part_category HAVING avg({f}::DOUBLE) IS NOT NULL"""
        for f in _NAMED),
    "vectors": "SELECT p.part_id, p.part_category, p.material, " + ", ".join(
        f"CASE WHEN s_{f}.std > 0 THEN round((coalesce(p.{f}::DOUBLE, s_{f}.mean) - s_{f}.mean) / s_{f}.std, 6) + 0.0 "
        f"ELSE 0.0 END::DOUBLE AS z_{f}" for f in _NAMED) + " FROM parts p " + " ".join(
        f"LEFT JOIN stats s_{f} ON s_{f}.part_category = p.part_category AND s_{f}.feature = '{f}'" for f in _NAMED),
    "wide_pairs": f"""SELECT a, b, part_category, material, dist, 1 / (1 + dist) AS sim FROM (
        SELECT x.part_id AS a, y.part_id AS b, x.part_category, x.material, {_distance()} AS dist
        FROM vectors x JOIN vectors y ON x.part_category = y.part_category AND x.material = y.material
        AND x.part_id < y.part_id) WHERE dist <= {WIDE_DISTANCE!r}::DOUBLE""",
    "pairs": f"SELECT * FROM wide_pairs WHERE dist <= {MATCH_DISTANCE!r}::DOUBLE",
    "grid_pairs": f"""SELECT p.* FROM wide_pairs p JOIN vectors x ON x.part_id = p.a JOIN vectors y ON y.part_id = p.b
        WHERE {' OR '.join('(' + _same_grid(i) + ')' for i in range(GRID_COUNT))}""",
    "lsh_places": """SELECT v.part_id, v.z, row_number() OVER (PARTITION BY v.part_id ORDER BY v.place) - 1 AS i
        FROM (SELECT part_id, part_category, unnest(""" + "[" + ", ".join(
        f"{{'place': {FEATURES.index(f)}, 'f': '{f}', 'z': CAST(round(z_{f} * 1e6) AS BIGINT)}}" for f in _ACTIVE) + "]" + """, recursive := true) FROM vectors) v
        JOIN stats s ON s.part_category = v.part_category AND s.feature = v.f AND s.std > 0""",
    "lsh_buckets": f"""SELECT part_id, t, floor(sum(z * ((((t + 1) * (i + 3) * 7919 + (i + 1) * (i + 1) * 104729 + t * t * 1299709) % 2001) - 1000))::DOUBLE
        / {lsh_width(WIDE_DISTANCE, len(_ACTIVE))}) AS bucket FROM lsh_places CROSS JOIN range({LSH_TABLES}) r(t) GROUP BY part_id, t""",
    "lsh_pairs": """SELECT p.* FROM wide_pairs p WHERE EXISTS (SELECT 1 FROM lsh_buckets x JOIN lsh_buckets y USING (t, bucket)
        WHERE x.part_id = p.a AND y.part_id = p.b)""",
    "ranked": f"""SELECT part_id, neighbor_id, dist, row_number() OVER (PARTITION BY part_id ORDER BY dist, neighbor_id) AS rank
        FROM (SELECT x.part_id, y.part_id AS neighbor_id, {_distance()} AS dist FROM vectors x JOIN vectors y
        ON x.part_category = y.part_category AND x.material = y.material AND x.part_id <> y.part_id)""",
    "label_dist": f"""SELECT t.*, {_distance()} AS dist, x.part_category = y.part_category AND x.material = y.material AS same_block FROM truth t
        JOIN vectors x ON x.part_id = base_part_id JOIN vectors y ON y.part_id = variant_part_id""",
    # groups
    "edges": "SELECT a AS u, b AS v FROM pairs UNION ALL SELECT b, a FROM pairs",
    "reach": "SELECT DISTINCT u AS id, u AS seen FROM edges UNION SELECT r.id, e.v FROM reach r JOIN edges e ON e.u = r.seen",
    "labels": "SELECT id AS part_id, min(seen) AS comp FROM reach GROUP BY id",
    "gids": f"""SELECT comp, {oracle_generator.group_digest('part_id')} AS group_id, count(*) AS n
        FROM labels GROUP BY comp""",
    "node_sim": """SELECT part_id, max(sim) AS similarity FROM (SELECT a AS part_id, sim FROM pairs
        UNION ALL SELECT b, sim FROM pairs) GROUP BY part_id""",
    "members": """SELECT group_id, part_id, similarity, model_id, machine_type, plant_id FROM labels
        JOIN gids USING (comp) JOIN node_sim USING (part_id) JOIN parts USING (part_id) JOIN models USING (model_id)""",
    "best": f"SELECT part_id, min({_NET}) AS member_best FROM offers GROUP BY part_id",
    "priced": """SELECT m.*, p.annual_volume, b.member_best FROM members m JOIN parts p USING (part_id)
        LEFT JOIN best b USING (part_id)""",
    "savings": """SELECT group_id, min(member_best) AS group_best_price,
        sum(member_best * annual_volume) AS total_current_spend,
        sum(CASE WHEN member_best IS NOT NULL THEN annual_volume::DOUBLE END) AS group_volume,
        sum(member_best * annual_volume) - sum(CASE WHEN member_best IS NOT NULL THEN annual_volume::DOUBLE END)
        * min(member_best) AS savings_potential FROM priced GROUP BY group_id""",
    "spans": """SELECT group_id, min(part_category) AS part_category, min(material) AS material, count(*) AS member_count,
        count(DISTINCT m.model_id) AS models_spanned, count(DISTINCT machine_type) AS machine_types_spanned,
        count(DISTINCT plant_id) AS plants_spanned, avg(similarity) AS avg_similarity
        FROM members m JOIN parts USING (part_id) GROUP BY group_id""",
    "groups": "SELECT * FROM spans JOIN savings USING (group_id)",
    # evaluation
    "verdicts": """SELECT t.*, CASE WHEN g.group_id = h.group_id THEN 1 ELSE 0 END AS same FROM truth t
        LEFT JOIN members g ON g.part_id = base_part_id LEFT JOIN members h ON h.part_id = variant_part_id""",
    "seeded": """SELECT base_part_id AS part_id FROM truth WHERE relationship = 'duplicate'
        UNION SELECT variant_part_id FROM truth WHERE relationship = 'duplicate'""",
    "coincidence": """SELECT part_category, count(*) AS grouped, count(s.part_id) AS seeded,
        count(*) - count(s.part_id) AS coincidental_parts FROM members m JOIN parts p USING (part_id)
        LEFT JOIN seeded s ON s.part_id = m.part_id GROUP BY part_category""",
    "counts": """SELECT part_category, count(*) FILTER (relationship = 'duplicate') AS dup_total,
        count(*) FILTER (relationship = 'duplicate' AND same = 1) AS dup_tp,
        count(*) FILTER (relationship = 'hard_negative' AND same = 1) AS hn_fp,
        count(*) FILTER (relationship = 'near_miss' AND same = 1) AS nm_fp FROM verdicts GROUP BY part_category""",
    "every": """SELECT part_category, coalesce(dup_total, 0) AS dup_total, coalesce(dup_tp, 0) AS dup_tp,
        coalesce(hn_fp, 0) AS hn_fp, coalesce(nm_fp, 0) AS nm_fp
        FROM (SELECT DISTINCT part_category FROM parts) LEFT JOIN counts USING (part_category)""",
    "rates": """SELECT *, dup_tp::DOUBLE / nullif(dup_total, 0) AS recall,
        dup_tp::DOUBLE / nullif(dup_tp + hn_fp + nm_fp, 0) AS precision FROM every""",
    "metrics": """SELECT r.part_category, recall, precision, 2 * precision * recall / nullif(precision + recall, 0) AS f1,
        dup_total, dup_tp, hn_fp, nm_fp, coalesce(coincidental_parts, 0) AS coincidental_parts
        FROM rates r LEFT JOIN coincidence USING (part_category)""",
    # review
    "log": f"""SELECT event_id AS seq, epoch_us(ts) AS updated_us, coalesce(group_id, sha256(part_id)) AS group_id,
        CASE event_type {' '.join(f"WHEN '{e}' THEN '{s}'" for e, s in OC.STATUS_OF_EVENT.items())} END AS status,
        'reviewer-' || user_id AS reviewer, 'note ' || event_id AS notes, part_id, event_type, value
        FROM (SELECT *, CAST(user_id * {OC.KEY_PER_USER} AS VARCHAR) AS part_id FROM events) e
        LEFT JOIN members USING (part_id)""",
    "reviews": f"""SELECT group_id, updated_us, seq, status, reviewer, notes FROM log
        WHERE status IN ({_CATEGORY_STATUS})
        QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY updated_us DESC, seq DESC) = 1""",
    "assigns": """SELECT group_id, updated_us AS assigned_us, seq, 'EPN-' || part_id || '-' || seq AS enterprise_part_number,
        reviewer AS assigned_by, notes FROM log WHERE event_type = 'purchase' AND value >= 10
        QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY updated_us DESC, seq DESC) = 1""",
    "normalized": """SELECT group_id AS normalized_part_id, enterprise_part_number, part_category, assigned_by,
        assigned_us, notes FROM assigns JOIN groups USING (group_id)""",
    # serving
    "smembers": """SELECT m.group_id, m.part_id, part_number, description, m.model_id, machine_type, plant_id, similarity,
        member_best AS member_best_price, p.annual_volume FROM priced m JOIN parts p USING (part_id)""",
    "soffers": """SELECT part_id, supplier_name, price_per_unit, unit_discount, lead_time_days, currency
        FROM offers JOIN vendors USING (supplier_id) WHERE part_id IN (SELECT part_id FROM members)""",
    "queue": """SELECT g.*, coalesce(r.status, 'new') AS status, r.status AS review_status,
        a.group_id IS NOT NULL AS normalized, a.enterprise_part_number FROM groups g
        LEFT JOIN reviews r USING (group_id) LEFT JOIN assigns a USING (group_id)""",
}
CTES.update(oracle_generator.ctes())
_WORD = re.compile(r"[a-z_]+")


@cache
def _needs(name):
    return [w for w in dict.fromkeys(_WORD.findall(CTES[name])) if w in CTES and w != name]


def _with(body):
    order, done = [], set()

    def visit(name):
        if name in done:
            return
        done.add(name)
        for n in _needs(name):
            visit(n)
        order.append(name)

    for w in dict.fromkeys(_WORD.findall(body)):
        if w in CTES:
            visit(w)
    head = ", ".join(f"{n} AS ({CTES[n]})" if n in ("reach", "g_reach") else f"{n} AS MATERIALIZED ({CTES[n]})" for n in order)
    return f"WITH RECURSIVE {head} {body}" if order else body


_F = registry.FILTERED
_GEN_COLUMNS = ", ".join(registry._VARIANT_COLUMNS)

BODIES = {
    "scan_parts": """SELECT part_id, model_id, part_number, part_category, material, description, length, weight, width,
        thickness, hole_count, conductor_count, annual_volume FROM parts""",
    "ingest_catalogs": """SELECT CASE WHEN n <= 6 THEN 'N' WHEN n <= 12 THEN 'S' WHEN n <= 18 THEN 'E' ELSE 'W' END || p_partkey AS part_id,
        p_brand AS part_number, p_type AS part_category,
        CASE WHEN n BETWEEN 7 AND 12 THEN p_size / 25.4::DOUBLE * 25.4::DOUBLE ELSE p_size::DOUBLE END AS length,
        CASE WHEN n <= 6 OR n BETWEEN 13 AND 18 THEN p_retailprice WHEN n <= 12 THEN p_retailprice / 1000::DOUBLE * 1000::DOUBLE END AS weight,
        NULL::DOUBLE AS width FROM (SELECT *, CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS INTEGER) AS n FROM part)""",
    "incremental_features": "SELECT part_id, CAST(CASE WHEN " + " AND ".join(f"z_{f} = 0" for f in FEATURES if f in _NAMED)
        + " THEN 1 ELSE 2 END AS BIGINT) AS version, part_category, material, " + ", ".join(
        f"z_{f}" if f in _NAMED else f"0.0::DOUBLE AS z_{f}" for f in FEATURES) + " FROM vectors WHERE NOT suffix(part_id, '-N')",
    "gen_range_suppliers": """SELECT 'S' || CASE WHEN s_suppkey < 1000 THEN lpad(CAST(s_suppkey AS VARCHAR), 3, '0')
        ELSE CAST(s_suppkey AS VARCHAR) END AS supplier_id, 'Supplier ' || s_suppkey AS supplier_name,
        ['North', 'South', 'East', 'West', 'Central'][s_suppkey % 5 + 1] AS region FROM supplier""",
    "gen_base_parts": f"SELECT {_GEN_COLUMNS} FROM g_base",
    "seed_duplicates": f"SELECT {_GEN_COLUMNS} FROM g_dup",
    "seed_hard_negatives": f"SELECT {_GEN_COLUMNS} FROM g_hard",
    "seed_near_misses": f"SELECT {_GEN_COLUMNS} FROM g_near",
    "gen_description": "SELECT part_id, description FROM g_parts",
    "gen_annual_volume": "SELECT part_id, annual_volume FROM g_parts",
    "gen_supplier_offers": "SELECT * FROM g_offers",
    "gen_ground_truth": """SELECT substr(part_id, 1, length(part_id) - 2) AS base_part_id, part_id AS variant_part_id,
        CASE right(part_id, 2) WHEN '-D' THEN 'duplicate' WHEN '-H' THEN 'hard_negative' ELSE 'near_miss' END AS relationship,
        part_category FROM g_every WHERE contains(part_id, '-')""",
    "gen_match_groups": f"SELECT {_GROUP_COLUMNS} FROM g_groups",
    "feature_stats": f"SELECT part_category, feature, {_round('mean', 6)}, {_round('std', 6)} FROM stats",
    "feature_vectors": " UNION ALL ".join(
        f"SELECT part_id, {i} AS position, {f'z_{f}' if f in _NAMED else '0.0::DOUBLE'} AS z FROM vectors"
        for i, f in enumerate(FEATURES)),
    "size_percentile": """SELECT part_id, part_category, weight,
        percent_rank() OVER (PARTITION BY part_category ORDER BY weight) AS size_pct FROM parts""",
    "near_pairs_exact": "SELECT a, b, part_category, material, dist, sim FROM pairs",
    "near_pairs_lsh": "SELECT a, b, part_category, material, dist, sim FROM lsh_pairs",
    "near_pairs_grid": "SELECT a, b, part_category, material, dist, sim FROM grid_pairs",
    "knn_topk": f"SELECT part_id, neighbor_id, dist, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= {registry.NEIGHBOURS}",
    "find_similar": f"""SELECT part_id, neighbor_id, CAST(rank AS INTEGER) AS rank, 1 / (1 + dist) AS sim FROM ranked
        WHERE rank <= {registry.SIMILAR} AND part_id IN (SELECT variant_part_id FROM truth)""",
    "find_similar_indexed": f"""SELECT part_id, neighbor_id, CAST(rank AS INTEGER) AS rank, 1 / (1 + dist) AS sim FROM ranked
        WHERE rank <= {registry.SIMILAR} AND part_id IN (SELECT part_id FROM vectors WHERE material = '{registry.MATERIAL}')""",
    "similarity_percentile": """SELECT a, b, part_category,
        percent_rank() OVER (PARTITION BY part_category ORDER BY dist DESC) AS sim_pct FROM wide_pairs""",
    "flag_bands": f"""SELECT a, b, part_category, sim, floor, low IS NOT NULL AS learned, CASE WHEN low IS NULL THEN 'review' WHEN sim >= high THEN 'auto'
        WHEN sim >= low THEN 'review' ELSE 'drop' END AS band FROM (
        SELECT a, b, part_category, max(sim) AS sim, bool_or(floor) AS floor FROM (
            SELECT a, b, part_category, sim, false AS floor FROM wide_pairs UNION ALL
            SELECT least(part_id, neighbor_id), greatest(part_id, neighbor_id), part_category, 1 / (1 + dist), true
            FROM ranked JOIN parts USING (part_id) WHERE rank <= {registry.NEIGHBOURS}) GROUP BY 1, 2, 3) LEFT JOIN (
        SELECT part_category, 1 / (1 + auto) AS high, 1 / (1 + greatest(auto, review)) AS low FROM (
            SELECT part_category, max(dist) FILTER (hits >= {AUTO_PRECISION!r}::DOUBLE * seen) AS auto,
            min(dist) FILTER (hits >= {REVIEW_RECALL!r}::DOUBLE * dups) AS review FROM (
                SELECT part_category, dist, count(*) FILTER (relationship = 'duplicate') OVER (PARTITION BY part_category ORDER BY dist) AS hits,
                count(*) OVER (PARTITION BY part_category ORDER BY dist) AS seen,
                count(*) FILTER (relationship = 'duplicate') OVER (PARTITION BY part_category) AS dups FROM label_dist WHERE same_block)
            WHERE dups >= {LEAST_LABELS} GROUP BY 1)) USING (part_category)""",
    "threshold_calibration": f"""SELECT relationship, count(*) AS pairs, {_round('min(dist)', 6, 'min_dist')},
        {_round('max(dist)', 6, 'max_dist')}, {_round('quantile_cont(dist, 0.5)', 6, 'p50_dist')},
        {_round('quantile_cont(dist, 0.99)', 6, 'p99_dist')} FROM label_dist GROUP BY relationship""",
    "connected_components": "SELECT part_id, comp FROM labels",
    "crowd_members": "SELECT group_id, part_id, similarity FROM members",
    "gen_best_offers": """SELECT supplier_id, part_id, net_price, price_per_unit, unit_discount, lead_time_days, currency, material_quality_grade
        FROM (SELECT *, price_per_unit * (1 - coalesce(unit_discount, 0)) AS net_price FROM g_offers)
        QUALIFY row_number() OVER (PARTITION BY supplier_id, part_id
            ORDER BY net_price, price_per_unit, unit_discount, lead_time_days, currency, material_quality_grade) = 1""",
    "group_ids": "SELECT group_id, part_id FROM labels JOIN gids USING (comp)",
    "member_similarity": "SELECT part_id, similarity FROM node_sim",
    "group_members": "SELECT * FROM members",
    "member_best_price": "SELECT part_id, member_best FROM best",
    "group_savings": f"""SELECT group_id, group_best_price, {_round('total_current_spend', 4)},
        group_volume, {_round('savings_potential', 4)} FROM savings""",
    "group_spans": f"""SELECT group_id, part_category, material, member_count, models_spanned, machine_types_spanned,
        plants_spanned, {_round('avg_similarity', 6)} FROM spans""",
    "match_groups": f"SELECT {_GROUP_COLUMNS} FROM groups",
    "offer_price_gap": f"""SELECT group_id, part_id, supplier_id, net_price, lead_time_days,
        min(net_price) OVER (PARTITION BY group_id) AS best_price,
        net_price - min(net_price) OVER (PARTITION BY group_id) AS price_gap
        FROM (SELECT group_id, part_id, supplier_id, {_NET} AS net_price, lead_time_days FROM members JOIN offers USING (part_id)
        QUALIFY row_number() OVER (PARTITION BY part_id, supplier_id ORDER BY {_NET}, price_per_unit) = 1)""",
    "group_price_leadtime_gap": f"""SELECT group_id, count(*) AS offer_count, max({_NET}) - min({_NET}) AS price_gap,
        max(lead_time_days) - min(lead_time_days) AS lead_time_gap FROM members JOIN offers USING (part_id) GROUP BY group_id""",
    "savings_by_plant": f"""SELECT plant_id, count(*) AS grouped_parts,
        {_round('coalesce(sum((member_best - group_best_price) * annual_volume), 0)', 4, 'savings_potential')}
        FROM priced JOIN savings USING (group_id) GROUP BY plant_id""",
    "rationalization_progress": f"""SELECT *, {_round('100.0::DOUBLE * grouped_parts / parts', 6, 'grouped_pct')},
        {_round('100.0::DOUBLE * normalized_parts / parts', 6, 'normalized_pct')} FROM (SELECT
        (SELECT count(*) FROM parts) AS parts, (SELECT count(*) FROM members) AS grouped_parts,
        (SELECT count(*) FROM members WHERE group_id IN (SELECT group_id FROM assigns)) AS normalized_parts)""",
    "sku_supplier_reduction": """SELECT CAST(sum(items) AS BIGINT) AS items_before, count(*) AS items_after,
        CAST(sum(items) - count(*) AS BIGINT) AS items_saved, CAST(sum(coalesce(suppliers, 0)) AS BIGINT) AS supplier_links_before,
        CAST(sum(greatest(coalesce(suppliers, 0) - 1, 0)) AS BIGINT) AS supplier_links_saved
        FROM (SELECT group_id, count(*) AS items FROM members GROUP BY 1) LEFT JOIN
        (SELECT group_id, count(DISTINCT supplier_id) AS suppliers FROM members JOIN offers USING (part_id) GROUP BY 1) USING (group_id)""",
    "ground_truth_labels": "SELECT * FROM truth",
    "eval_pair_verdicts": "SELECT base_part_id, variant_part_id, relationship, part_category, same FROM verdicts",
    "eval_metrics": f"""SELECT part_category, {_round('recall', 9)}, {_round('precision', 9)}, {_round('f1', 9)},
        dup_total, dup_tp, hn_fp, nm_fp, coincidental_parts FROM metrics""",
    "eval_coincidental": "SELECT * FROM coincidence",
    "eval_violations": "SELECT relationship, count(*) AS pairs, CAST(sum(same) AS BIGINT) AS same_group FROM verdicts GROUP BY 1",
    "eval_gate": f"""SELECT part_category, {_round('recall', 9)}, {_round('precision', 9)}, {_round('f1', 9)},
        coalesce(recall >= 0.95 AND precision >= 0.95 AND f1 >= 0.95, false) AS passed FROM metrics""",
    "dq_row_counts": " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, count(*) AS row_count FROM {source}" for name, source in (
            ("plants", "region"), ("models", "models"), ("suppliers", "vendors"), ("parts", "parts"),
            ("supplier_catalogs", "offers"), ("ground_truth", "truth"))),
    "dq_attr_collisions": """SELECT count(*) AS colliding_sets, CAST(coalesce(sum(n), 0) AS BIGINT) AS colliding_parts FROM (
        SELECT count(*) AS n FROM base GROUP BY part_category, material, length, width, thickness, hole_count, conductor_count
        HAVING count(*) > 1)""",
    "dq_fk_integrity": " UNION ALL ".join(
        f"SELECT '{child}.{column}' AS foreign_key, count(*) AS orphan_rows FROM {source} "
        f"WHERE {column} IS NOT NULL AND {column} NOT IN (SELECT {key} FROM {parent})"
        for child, column, source, parent, key in (
            ("models", "plant_id", "models", "(SELECT CAST(r_regionkey AS VARCHAR) AS id FROM region)", "id"),
            ("parts", "model_id", "parts", "models", "model_id"),
            ("supplier_catalogs", "supplier_id", "offers", "vendors", "supplier_id"),
            ("supplier_catalogs", "part_id", "offers", "parts", "part_id"),
            ("ground_truth", "base_part_id", "truth", "parts", "part_id"),
            ("ground_truth", "variant_part_id", "truth", "parts", "part_id"),
            ("parts", "normalized_part_id", "(SELECT a.group_id AS normalized_part_id FROM parts JOIN members USING (part_id) JOIN assigns a USING (group_id))",
             "normalized", "normalized_part_id"))),
    "dq_part_number_within_model": """SELECT model_id, part_number, count(*) AS uses FROM parts GROUP BY 1, 2
        HAVING count(*) > 1""",
    "dq_blocking_keys": """SELECT count(*) AS parts, count(*) FILTER (part_category IS NULL) AS null_category,
        count(*) FILTER (material IS NULL) AS null_material FROM parts""",
    "dq_labels_complete": """SELECT coalesce(v.part_category, t.part_category) AS part_category,
        count(v.part_id) AS variants, count(variant_part_id) AS labels,
        count(*) FILTER (variant_part_id IS NULL) AS unlabelled, count(*) FILTER (v.part_id IS NULL) AS labels_without_part
        FROM (SELECT * FROM parts WHERE contains(part_id, '-')) v FULL JOIN truth t ON v.part_id = variant_part_id GROUP BY 1""",
    "dq_block_purity": """SELECT count(*) AS groups, count(*) FILTER (c > 1 OR m > 1) AS mixed_groups FROM (
        SELECT group_id, count(DISTINCT part_category) AS c, count(DISTINCT material) AS m
        FROM members JOIN parts USING (part_id) GROUP BY 1)""",
    "dq_currencies": "SELECT currency, count(*) AS offers FROM offers GROUP BY 1",
    "dq_review_roundtrip": f"""SELECT count(*) AS groups, count(*) FILTER (have IS NULL) AS lost,
        count(*) FILTER (want IS NULL) AS invented, count(*) FILTER (want <> have) AS stale, 0::BIGINT AS altered
        FROM (SELECT group_id, max(updated_us) AS want FROM log WHERE status IN ({_CATEGORY_STATUS}) GROUP BY 1)
        FULL JOIN (SELECT group_id, updated_us AS have FROM reviews) USING (group_id)""",
    "dq_primary_keys": " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, count(*) AS repeated_keys, CAST(coalesce(sum(n), 0) AS BIGINT) AS repeated_rows "
        f"FROM (SELECT count(*) AS n FROM {source} GROUP BY {key} HAVING count(*) > 1)"
        for name, source, key in (
            ("plants", "region", "r_regionkey"), ("models", "models", "model_id"), ("suppliers", "vendors", "supplier_id"),
            ("parts", "parts", "part_id"), ("supplier_catalogs", "offers", "supplier_id, part_id"),
            ("ground_truth", "truth", "variant_part_id"))),
    "dq_not_null": " UNION ALL ".join(
        f"SELECT '{name}.{column}' AS column_name, count(*) FILTER ({source_column} IS NULL) AS null_rows FROM {source}"
        for name, source, columns in (
            ("plants", "region", {"plant_id": "r_regionkey"}),
            ("models", "models", {c: c for c in ("model_id", "plant_id", "machine_type")}),
            ("suppliers", "vendors", {"supplier_id": "supplier_id"}),
            ("parts", "parts", {c: c for c in ("part_id", "model_id", "part_number", "part_category", "material")}),
            ("supplier_catalogs", "offers", {c: c for c in ("supplier_id", "part_id")}),
            ("ground_truth", "truth", {c: c for c in ("base_part_id", "variant_part_id", "relationship")}))
        for column, source_column in columns.items()),
    "review_state_latest": "SELECT * FROM reviews",
    "review_rejects": f"""SELECT seq, group_id, status, updated_us FROM log
        WHERE status IS NULL OR status NOT IN ({_CATEGORY_STATUS})""",
    "assignment_state_latest": "SELECT * FROM assigns",
    "normalized_parts": "SELECT * FROM normalized",
    "apply_normalized_ids": """SELECT p.part_id, a.group_id AS normalized_part_id FROM parts p
        LEFT JOIN members USING (part_id) LEFT JOIN assigns a USING (group_id)""",
    "suppress_reviewed": """SELECT group_id, part_category, material, member_count FROM queue
        WHERE review_status IS NULL OR review_status = 'new'""",
    "orphaned_reviews": """SELECT group_id, status, updated_us FROM reviews
        WHERE group_id NOT IN (SELECT group_id FROM groups)""",
    "serve_match_groups": f"SELECT {_GROUP_COLUMNS} FROM groups",
    "serve_members": "SELECT * FROM smembers",
    "serve_supplier_offers": "SELECT * FROM soffers",
    "queue_default": f"""SELECT {_QUEUE_COLUMNS} FROM (SELECT * FROM queue WHERE status = 'new' AND models_spanned > 1
        ORDER BY savings_potential DESC NULLS LAST, group_id LIMIT 100)""",
    "queue_page": f"""SELECT {_QUEUE_COLUMNS} FROM (SELECT * FROM queue
        ORDER BY avg_similarity ASC NULLS LAST, group_id LIMIT 20 OFFSET 10)""",
    "queue_total": "SELECT count(*) AS total FROM queue WHERE status = 'new' AND models_spanned > 1",
    "queue_filtered": f"""SELECT {_QUEUE_COLUMNS} FROM queue WHERE part_category = '{_F['part_category']}'
        AND models_spanned > 1 AND plants_spanned > 1 AND savings_potential >= {_F['min_savings']}
        AND avg_similarity >= {_F['min_similarity']} AND member_count >= {_F['min_group_size']} AND NOT normalized
        AND EXISTS (SELECT 1 FROM members x WHERE x.group_id = queue.group_id AND machine_type = '{_F['machine_type']}')""",
    "queue_by_machine_type": f"""SELECT {_QUEUE_COLUMNS} FROM queue WHERE EXISTS (SELECT 1 FROM members x
        WHERE x.group_id = queue.group_id AND machine_type = '{registry.MACHINE}')""",
    "queue_by_supplier": f"""SELECT {_QUEUE_COLUMNS} FROM queue WHERE EXISTS (SELECT 1 FROM members x JOIN soffers o
        ON o.part_id = x.part_id WHERE x.group_id = queue.group_id AND supplier_name = '{registry.SUPPLIER}')""",
    "queue_unnormalized": f"SELECT {_QUEUE_COLUMNS} FROM queue WHERE NOT normalized",
    "queue_normalized": f"SELECT {_QUEUE_COLUMNS} FROM queue WHERE normalized",
    "queue_by_material": f"SELECT {_QUEUE_COLUMNS} FROM queue WHERE material = '{registry.MATERIAL}'",
    "queue_spanning_types": f"SELECT {_QUEUE_COLUMNS} FROM queue WHERE machine_types_spanned > 1",
    "queue_by_model": f"""SELECT {_QUEUE_COLUMNS} FROM queue WHERE EXISTS (SELECT 1 FROM members x
        WHERE x.group_id = queue.group_id AND CAST(model_id AS VARCHAR) = '{registry.MODEL}')""",
    "queue_by_plant": f"""SELECT {_QUEUE_COLUMNS} FROM queue WHERE EXISTS (SELECT 1 FROM members x
        WHERE x.group_id = queue.group_id AND CAST(plant_id AS VARCHAR) = '{registry.PLANT}')""",
    "group_detail_header": f"""SELECT g.group_id, g.part_category, g.material, g.member_count, g.models_spanned,
        g.machine_types_spanned, g.plants_spanned, {_SUM_COLUMNS}, coalesce(r.status, 'new') AS status, r.reviewer, r.notes,
        r.updated_us, a.enterprise_part_number, a.assigned_by, a.assigned_us, a.notes AS normalize_notes
        FROM groups g LEFT JOIN reviews r USING (group_id) LEFT JOIN assigns a USING (group_id)""",
    "group_detail_members": "SELECT * FROM smembers",
    "group_detail_offers": f"""SELECT group_id, part_id, part_number, supplier_name, price_per_unit, unit_discount,
        {_NET} AS net_price, lead_time_days, currency FROM smembers JOIN soffers USING (part_id)""",
    "filter_options": """SELECT DISTINCT 'part_category' AS filter, part_category AS value FROM groups UNION ALL
        SELECT DISTINCT 'material', material FROM groups UNION ALL SELECT DISTINCT 'model', model_id FROM members UNION ALL
        SELECT DISTINCT 'plant', plant_id FROM members UNION ALL SELECT DISTINCT 'supplier', supplier_name FROM soffers""",
    "dash_kpi": """SELECT round(coalesce(sum(savings_potential), 0), 0) AS total_savings, count(*) AS total_groups,
        CAST(coalesce(sum(member_count), 0) AS BIGINT) AS total_parts,
        (SELECT count(*) FROM normalized) AS normalized_groups FROM groups""",
    "dash_engine_overall": """SELECT round(100 * sum(dup_tp)::DOUBLE / sum(dup_total), 1) AS recall_pct,
        round(100 * sum(dup_tp)::DOUBLE / sum(dup_tp + hn_fp + nm_fp), 1) AS precision_pct FROM metrics""",
    "dash_by_category": """SELECT part_category, round(coalesce(sum(savings_potential), 0), 2) AS savings, count(*) AS groups
        FROM groups GROUP BY 1""",
    "dash_by_span": """SELECT CASE WHEN plants_spanned > 1 THEN 'Cross-plant' WHEN machine_types_spanned > 1 THEN 'Cross-type'
        WHEN models_spanned > 1 THEN 'Cross-model' ELSE 'Intra-model' END AS span_level,
        round(coalesce(sum(savings_potential), 0), 2) AS savings, count(*) AS groups FROM groups GROUP BY 1""",
    "dash_status": "SELECT status, count(*) AS groups FROM queue GROUP BY 1",
    "dash_eval": """SELECT part_category, round(recall, 3) AS recall, round(precision, 3) AS precision, round(f1, 3) AS f1,
        dup_tp, dup_total, hn_fp, nm_fp, coincidental_parts FROM metrics""",
    "similarity_histogram": """SELECT part_category, CAST(floor(sim * 100) AS INTEGER) AS percent, count(*) AS pairs
        FROM wide_pairs GROUP BY 1, 2""",
    "concentration_by_machine_type": """SELECT machine_type, count(*) AS grouped_parts, count(DISTINCT group_id) AS groups,
        round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM members), 2) AS share_pct FROM members GROUP BY 1""",
    "cross_type_groups": f"SELECT {_GROUP_COLUMNS} FROM groups WHERE machine_types_spanned > 1",
    "parts_dup_other_plant": """SELECT part_id, group_id, plant_id FROM members m WHERE EXISTS (
        SELECT 1 FROM members o WHERE o.group_id = m.group_id AND o.plant_id <> m.plant_id)""",
    "similar_cross_type_faster": """SELECT x.part_id, y.part_id AS similar_part_id, sim, x.lead AS lead_time_days,
        y.lead AS similar_lead_time_days FROM (SELECT a AS i, b AS j, sim FROM pairs UNION ALL SELECT b, a, sim FROM pairs)
        JOIN (SELECT part_id, machine_type, lead FROM parts JOIN models USING (model_id)
              JOIN (SELECT part_id, min(lead_time_days) AS lead FROM offers GROUP BY 1) USING (part_id)) x ON x.part_id = i
        JOIN (SELECT part_id, machine_type, lead FROM parts JOIN models USING (model_id)
              JOIN (SELECT part_id, min(lead_time_days) AS lead FROM offers GROUP BY 1) USING (part_id)) y ON y.part_id = j
        WHERE sim >= 0.95 AND x.machine_type = 'Tractor' AND y.machine_type = 'Harvester' AND y.lead < x.lead""",
}


def oracle_sql():
    return {name: _with(body) for name, body in BODIES.items()}
