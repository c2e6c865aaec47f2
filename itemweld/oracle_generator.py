"""DuckDB SQL of the generated catalogue, for the result checks.

The draws are Murmur3 with seed 42 over each argument in turn, written with list
lambdas so that every intermediate value is computed once.
"""

from itemweld.schema import ATTRIBUTES, FEATURES, INTEGER_ATTRIBUTES, MATCH_DISTANCE
from itemweld.sources import generator as G

_MASK = "4294967295::UBIGINT"
_names = iter(range(10**9))


def group_digest(column):
    """The group id's definition: sha256 of the member count and of the sums of four 60-bit
    pieces of the members' hashes."""
    sums = [f"CAST(sum(CAST('0x' || substr(sha256({column}), {1 + 15 * i}, 15) AS BIGINT)) AS VARCHAR)" for i in range(4)]
    return f"sha256(concat_ws('|', CAST(count(*) AS VARCHAR), {', '.join(sums)}))"


def _let(value, body):
    name = f"v{next(_names)}"
    return f"list_transform([{value}], lambda {name}: {body(name)})[1]"


def _mixed(words):
    a, b, c = (f"w{next(_names)}" for _ in range(3))
    return (f"list_transform(list_transform(list_transform({words}, lambda {a}: ({a} * 3432918353::UBIGINT) & {_MASK}), "
            f"lambda {b}: (({b} << 15) | ({b} >> 17)) & {_MASK}), lambda {c}: ({c} * 461845907::UBIGINT) & {_MASK})")


def _fold(words, seed):
    h, k = f"h{next(_names)}", f"k{next(_names)}"
    x = f"xor({h}, {k})"
    return (f"list_reduce({_mixed(words)}, lambda {h}, {k}: "
            f"(((({x} << 13) | ({x} >> 19)) & {_MASK}) * 5::UBIGINT + 3864292196::UBIGINT) & {_MASK}, {seed})")


def _finish(h, length):
    step1 = _let(f"xor({h}, {length})", lambda v: f"(xor({v}, {v} >> 16) * 2246822507::UBIGINT) & {_MASK}")
    step2 = _let(step1, lambda v: f"(xor({v}, {v} >> 13) * 3266489909::UBIGINT) & {_MASK}")
    return _let(step2, lambda v: f"xor({v}, {v} >> 16)")


def _text_words(column):
    i, j = f"i{next(_names)}", f"j{next(_names)}"
    byte = lambda at: f"ascii(substr({column}, ({at})::INTEGER, 1))::UBIGINT"
    quad = " + ".join(f"{256 ** n}::UBIGINT * {byte(f'4 * {i} + {n + 1}')}" for n in range(4))
    return (f"list_concat(list_transform(range(length({column}) // 4), lambda {i}: {quad}), "
            f"list_transform(range(4 * (length({column}) // 4), length({column})), lambda {j}: {byte(f'{j} + 1')}))")


def murmur(*parts):
    """Unsigned hash of parts: ('long'|'int'|'text', column) or a constant."""
    h = "42::UBIGINT"
    for part in parts:
        if isinstance(part, int):
            words, length = f"[{part}::UBIGINT]", "4::UBIGINT"
        elif isinstance(part, str):
            data = part.encode()
            cut = len(data) // 4 * 4
            numbers = [int.from_bytes(data[i:i + 4], "little") for i in range(0, cut, 4)] + list(data[cut:])
            words, length = "[" + ", ".join(f"{n}::UBIGINT" for n in numbers) + "]", f"{len(data)}::UBIGINT"
        else:
            kind, column = part
            if kind == "int":
                words, length = f"[{column}::UBIGINT]", "4::UBIGINT"
            elif kind == "long":
                words, length = f"[{column}::UBIGINT & {_MASK}, {column}::UBIGINT >> 32]", "8::UBIGINT"
            else:
                words, length = _text_words(column), f"length({column})::UBIGINT"
        h = _finish(_fold(words, h), length)
    return h


def draw(n, *parts):
    signed = _let(murmur(*parts), lambda v: f"CASE WHEN {v} >= 2147483648 THEN {v}::BIGINT - 4294967296 ELSE {v}::BIGINT END")
    return _let(signed, lambda v: f"((({v} % {n}) + {n}) % {n})")


def half_up(value, digits):
    """Round a double by its shortest decimal text, ties away from zero."""
    return f"CAST(CAST(CAST({value} AS VARCHAR) AS DECIMAL(28, {digits})) AS DOUBLE)"


def _quote(text):
    return "'" + text.replace("'", "''") + "'"


def _list(values):
    return "[" + ", ".join(_quote(v) if isinstance(v, str) else str(v) for v in values) + "]"


def _case(column, table, otherwise="NULL"):
    whens = " ".join(f"WHEN {_quote(k)} THEN {v}" for k, v in table.items())
    return f"CASE {column} {whens} ELSE {otherwise} END"


def _continuous(number, attribute, low, high, digits):
    """low + u * (high - low) / 100000 with u in 0..99999, in whole numbers: tenths
    of 1e-5, rounded half up, then one division."""
    low10, span10 = round(float(low) * 10), round((float(high) - float(low)) * 10)
    u = draw(100_000, ("long", "id"), f"{number}_{attribute}")
    scaled = f"({low10} * 100000::BIGINT + {u} * {span10})"          # value * 1e6
    return f"(({scaled} * {2 * 10 ** digits} + 1000000) // 2000000) / {10 ** digits}::DOUBLE"


def _attributes():
    cases = {}
    for number, name in enumerate(G.CATEGORIES):
        for attribute, spec in G.CONTINUOUS[name].items():
            cases.setdefault(attribute, {})[name] = _continuous(number, attribute, *spec)
        for attribute, (low, high) in G.WHOLE.get(name, {}).items():
            cases.setdefault(attribute, {})[name] = f"{low} + {draw(high - low + 1, ('long', 'id'), f'{number}_{attribute}')}"
    return cases


def ctes():
    category = f"{_list(G.CATEGORIES)}[id % {len(G.CATEGORIES)} + 1]"
    cases = _attributes()
    drawn = ", ".join(f"{_case('part_category', c)} AS {a}" for a, c in cases.items())
    material = _case("part_category", {
        c: f"{_list(m)}[{draw(len(m), ('long', 'id'), 3)} + 1]" for c, m in G.MATERIALS.items()})
    density = _case("material", {m: f"{d}::DOUBLE" for m, d in G.DENSITY.items()}, "5.0::DOUBLE")
    names = G.model_names()
    dec = lambda c: f"CAST({c} AS DECIMAL(12, 2))"
    long_side = f"greatest(coalesce({', '.join(map(dec, ['length', 'outer_diameter', 'diameter', 'inner_diameter']))}, 10.0), 1.0)"
    short_side = f"greatest(coalesce({', '.join(map(dec, ['width', 'thickness', 'cross_section_diameter', 'gauge', 'head_width']))}, 5.0), 1.0)"
    # hundredths times hundredths times hundredths, divided by 1000, to 3 digits
    whole = lambda x: f"CAST(({x}) * 100 AS BIGINT)"
    product = f"{whole(dec('material_density'))} * {whole(long_side)} * {whole(short_side)}"
    every = [c for c in ATTRIBUTES]
    measures = ["weight"] + [a for a in ATTRIBUTES if a not in INTEGER_ATTRIBUTES]
    pid = ("text", "part_id")

    def jitter(c):
        return half_up(f"{c} * (1 + ({draw(41, pid, f'j_{c}')} - 20) / 2000::DOUBLE)", 3)

    def hard(column):
        now = column
        for kind, (attribute, operation, amount, digits) in G.HARD_NEGATIVE.items():
            if attribute != column:
                continue
            new = f"{column} + {amount}" if operation == "plus" else f"{column} * {amount}::DOUBLE"
            if digits is not None:
                new = half_up(new, digits)
            now = f"CASE WHEN part_category = {_quote(kind)} THEN {new} ELSE {now} END"
        return now

    cols = ["part_id", "model_id", "part_number", "part_category", "material", "material_density", "weight"] + every

    def variant(suffix, n, salts, changed):
        out = []
        for c in cols:
            if c == "part_id":
                out.append(f"part_id || '-{suffix}' AS part_id")
            elif c == "part_number":
                out.append(f"part_number || '{suffix}' AS part_number")
            else:
                out.append(f"{changed.get(c, c)} AS {c}")
        return f"SELECT {', '.join(out)} FROM g_base WHERE {draw(n, pid, *salts)} = 0"

    moved = (f"{_list(names)}[((list_position({_list(names)}, model_id) + "
             f"{draw(len(names) - 1, pid, 'vm')}) % {len(names)}) + 1]")

    def text(piece):
        if isinstance(piece, str):
            return _quote(piece)
        c, how = piece
        if how == "int":
            return f"CAST(CAST(trunc({c}) AS INTEGER) AS VARCHAR)"
        if how == "num":
            return f"CAST({half_up(c, 1)} AS VARCHAR)"
        return f"CAST({c} AS VARCHAR)"

    body = _case("part_category", {c: " || ".join(text(p) for p in pieces) for c, pieces in G.DESCRIPTION.items()})
    volume = (f"CAST({half_up('(' + _case('part_category', G.VOLUME_LOW, G.VOLUME_LOW_ELSE) + ') * pow(' + _case('part_category', {k: f'{v}::DOUBLE' for k, v in G.VOLUME_RATIO.items()}, f'{G.VOLUME_RATIO_ELSE}::DOUBLE') + ', ' + draw(100_000, pid, 'vol') + ' / 100000::DOUBLE)', 0)} AS INTEGER)")
    oi = ("int", "oi")
    dbl = lambda t: {k: f"{v}::DOUBLE" for k, v in t.items()}
    return {
        "g_ids": "SELECT p_partkey AS id FROM part",
        "g_drawn": f"""SELECT *, round(inner_diameter + _wall, 1) AS outer_diameter,
            {half_up('nominal_diameter * 1.6::DOUBLE', 2)} AS head_width, {material} AS material
            FROM (SELECT *, {drawn} FROM (SELECT id, {category} AS part_category FROM g_ids))""",
        "g_dense": f"""SELECT *, {', '.join(f'NULL::DOUBLE AS {a}' for a in ATTRIBUTES if a not in cases and a not in ('outer_diameter', 'head_width')) or 'NULL AS none_missing'},
            {density} AS material_density FROM g_drawn""",
        "g_base": f"""SELECT 'P' || lpad(CAST(id AS VARCHAR), CAST(greatest(7, length(CAST(id AS VARCHAR))) AS INTEGER), '0') AS part_id,
            {_list(names)}[{draw(len(names), ('long', 'id'), 201)} + 1] AS model_id,
            {_list(G.NUMBER_PREFIX)}[id % {len(G.CATEGORIES)} + 1] || '-' || lpad(CAST(id % 20000 AS VARCHAR), 5, '0') AS part_number,
            part_category, material, material_density,
            (({product}) * 2 + 1000000) // 2000000 / 1000::DOUBLE AS weight,
            {', '.join(f'CAST({c} AS INTEGER) AS {c}' if c in INTEGER_ATTRIBUTES else c for c in every)} FROM g_dense""",
        "g_dup": variant("D", G.DUPLICATE_ONE_IN, [], {"model_id": moved, **{m: jitter(m) for m in measures}}),
        "g_hard": variant("H", G.HARD_NEGATIVE_ONE_IN, ["hn"], {c: hard(c) for c in every}),
        "g_near": variant("N", G.NEAR_MISS_ONE_IN, ["nm"], {
            "material": _case("part_category", {k: _quote(v) for k, v in G.NEAR_MISS_MATERIAL.items()}),
            "material_density": _case("part_category", {
                k: f"{G.DENSITY[v]}::DOUBLE" for k, v in G.NEAR_MISS_MATERIAL.items()})}),
        "g_every": "SELECT * FROM g_base UNION ALL SELECT * FROM g_dup UNION ALL SELECT * FROM g_hard UNION ALL SELECT * FROM g_near",
        "g_parts": f"""SELECT *, concat_ws(', ', material || ' ' || part_category, {body}, 'PN ' || part_number) AS description,
            {volume} AS annual_volume FROM g_every""",
        "g_sized": """SELECT part_id, part_category, material,
            percent_rank() OVER (PARTITION BY part_category ORDER BY weight) AS size_pct FROM g_every""",
        "g_listed": f"""SELECT part_id, {_case('part_category', dbl(G.PRICE_LOW))}
            * pow({_case('part_category', dbl(G.PRICE_RATIO))}, size_pct)
            * {_case('material', dbl(G.PRICE_OF_MATERIAL), '1.0::DOUBLE')} AS list_price FROM g_sized""",
        "g_offer_rows": f"SELECT part_id, list_price, unnest(range(0, {draw(3, pid)} + 1)) AS oi FROM g_listed",
        "g_offers": f"""SELECT 'S' || lpad(CAST({draw(G.SUPPLIER_COUNT, pid, oi)} AS VARCHAR), 3, '0') AS supplier_id, part_id,
            {half_up(f"list_price * (0.8::DOUBLE + {draw(41, pid, oi, 'p')} / 100::DOUBLE)", 2)} AS price_per_unit,
            {draw(15, pid, oi, 'd')} / 100::DOUBLE AS unit_discount,
            CAST({_list(G.LEAD_TIMES)}[{draw(len(G.LEAD_TIMES), pid, oi, 'l')} + 1] AS INTEGER) AS lead_time_days,
            'USD' AS currency, {_list(G.GRADES)}[{draw(len(G.GRADES), pid, oi, 'q')} + 1] AS material_quality_grade
            FROM g_offer_rows""",
        # the match build over all features, in long form
        "g_long": " UNION ALL ".join(
            f"SELECT part_id, part_category, material, {i} AS f, CAST({c} AS DOUBLE) AS x FROM g_every"
            for i, c in enumerate(FEATURES)),
        "g_stats": """SELECT part_category, f, avg(x) AS mean, stddev_pop(x) AS std FROM g_long
            WHERE NOT contains(part_id, '-') GROUP BY part_category, f HAVING stddev_pop(x) > 0""",
        "g_scores": """SELECT part_id, part_category, material, f, round((coalesce(x, mean) - mean) / std, 6) AS z
            FROM g_long JOIN g_stats USING (part_category, f)""",
        "g_pairs": f"""SELECT x.part_id AS a, y.part_id AS b, 1 / (1 + sqrt(sum((x.z - y.z) * (x.z - y.z)))) AS sim
            FROM g_scores x JOIN g_scores y ON x.part_category = y.part_category AND x.material = y.material
            AND x.f = y.f AND x.part_id < y.part_id GROUP BY 1, 2
            HAVING sqrt(sum((x.z - y.z) * (x.z - y.z))) <= {MATCH_DISTANCE!r}::DOUBLE""",
        "g_edges": "SELECT a AS u, b AS v, sim FROM g_pairs UNION ALL SELECT b, a, sim FROM g_pairs",
        "g_reach": "SELECT DISTINCT u AS id, u AS seen FROM g_edges UNION SELECT r.id, e.v FROM g_reach r JOIN g_edges e ON e.u = r.seen",
        "g_labels": "SELECT id AS part_id, min(seen) AS comp FROM g_reach GROUP BY id",
        "g_gids": f"SELECT comp, {group_digest('part_id')} AS group_id FROM g_labels GROUP BY comp",
        "g_best": """SELECT part_id, min(price_per_unit * (1 - coalesce(unit_discount, 0))) AS best FROM g_offers GROUP BY 1""",
        "g_near_sim": "SELECT u AS part_id, max(sim) AS similarity FROM g_edges GROUP BY 1",
        "g_groups": """SELECT group_id, min(part_category) AS part_category, min(material) AS material,
            count(*) AS member_count, count(DISTINCT model_id) AS models_spanned,
            count(DISTINCT substr(model_id, 1, 2)) AS machine_types_spanned,
            count(DISTINCT split_part(model_id, '_', 1)) AS plants_spanned, avg(similarity) AS avg_similarity,
            min(best) AS group_best_price, sum(best * annual_volume) AS total_current_spend,
            sum(best * annual_volume) - sum(annual_volume::DOUBLE) * min(best) AS savings_potential
            FROM g_labels JOIN g_gids USING (comp) JOIN g_parts USING (part_id) JOIN g_best USING (part_id)
            JOIN g_near_sim USING (part_id) GROUP BY group_id""",
    }
