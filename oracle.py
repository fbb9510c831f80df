"""The registered queries as SQL over the same tables, for DuckDB.

Each statement is written from the meaning of the query, with common table
expressions that are put in front of it as needed.
"""

from __future__ import annotations


def _file(key: str) -> str:
    return f"""concat(
        case when {key} % 10 = 0 then 'Blanc' when {key} % 10 = 1 then 'POOL'
             when {key} % 10 = 2 then 'cal' else 'Sample' end, '_',
        case when {key} % 3 = 0 then '2022_05' when {key} % 3 = 1 then '2023' else 'run' end,
        '%20', cast({key} as varchar), '.parquet')"""


_PARTS = {
    "peaks": f"""
        select {_file('l_suppkey')} as file,
               case when l_linestatus = 'F' then '1' else '2' end as mslevel,
               cast(l_quantity * 10 + l_linenumber as bigint) as scanid,
               l_quantity * cast(0.1 as double) as rt,
               cast(150 as double) + (l_partkey % 4) * 5 + l_discount + l_tax / 10 as mz,
               l_extendedprice as intensity
        from lineitem""",
    "manifest": f"""
        select {_file('s_suppkey')} as file, cast(s_suppkey as bigint) as pos from supplier
        union all select 'Sample_empty.parquet', cast(-1 as bigint)""",
    "metadata": f"""
        select name, cast(2019 + k % 5 as int) as year, cast(1 + k % 12 as int) as month from named
        union all
        select case when k % 6 = 0 then name else concat('Old_', name) end, 2007, 1 from named""",
    "named": f"""
        select s_suppkey as k,
               concat(case when s_suppkey % 7 = 3 then 'Other_' else '' end,
                      case when s_suppkey % 2 = 0 then {_file('s_suppkey')}
                           else replace({_file('s_suppkey')}, '%20', ' ') end) as name
        from supplier""",
    "molecules": """
        select cast(r_regionkey as bigint) as target_id,
               concat('mol_', cast(r_regionkey as varchar)) as name,
               cast(150 as double) + r_regionkey * 5 + cast(0.0523 as double) as mz
        from region""",
    "library": """
        select cast(p_partkey as bigint) as target_id,
               concat('part_', cast(p_partkey as varchar)) as name,
               cast(149.9 as double) + p_partkey * cast(0.01 as double) + cast(0.0003 as double) as mz
        from part""",
    "latest": """
        select name, year, month from (
            select *, row_number() over (partition by name order by year desc nulls last, month) as place
            from metadata) where place = 1""",
    "decoded": """
        select key, year, month from (
            select url_decode(name) as key, year, month,
                   row_number() over (partition by url_decode(name) order by name) as place
            from latest) where place = 1""",
    "dated": """
        select f.file, f.pos, d.year, d.month, d.year * 100 + d.month as date_order,
               case when d.year is not null and d.month is not null
                    then format('E-{}_{:02d}-{}.parquet', d.year, d.month,
                                replace(regexp_replace(f.file, '[.]parquet$', ''), '%20', ' '))
                    else replace(f.file, '%20', ' ') end as display_name
        from manifest f
        left join (
            select file, year, month from (
                select *, row_number() over (partition by file order by step) as place from (
                    select f.file, 1 as step, m.year, m.month
                    from manifest f join latest m on f.file = m.name
                    union all
                    select f.file, 2, m.year, m.month
                    from manifest f join decoded m on url_decode(f.file) = m.key
                    union all
                    select f.file, 3, m.year, m.month
                    from manifest f join latest m on url_decode(f.file) = m.name))
            where place = 1) d on d.file = f.file""",
    "matched": """
        select t.target_id, t.name as molecule, t.mz as target_mz,
               p.file, p.rt, p.scanid, p.mz, p.intensity
        from peaks p join molecules t
          on p.mz between t.mz - cast(0.01 as double) and t.mz + cast(0.01 as double)
        where p.mslevel = '1' and p.intensity >= 0""",
    "eic": """
        select target_id, molecule, target_mz, file, rt, sum(intensity) as intensity
        from matched group by all""",
    "grid": """
        select t.target_id, t.name as molecule, t.mz as target_mz, f.file, f.pos
        from manifest f, molecules t""",
    "apex": """
        select target_id, file, intensity, rt from (
            select *, row_number() over (partition by target_id, file order by intensity desc, rt) as place
            from eic) where place = 1""",
    "mx": """
        select g.target_id, g.molecule, g.file, g.pos, coalesce(a.intensity, 0) as max_intensity,
               a.rt as rt_at_max, case when a.rt is not null then g.target_mz end as target_mz
        from grid g left join apex a using (target_id, file)""",
    "summary": """
        select g.molecule, g.file, a.rt is not null as detected, a.intensity as max_intensity,
               a.rt as rt_at_max, coalesce(s.n, 0) as n_points,
               case when s.n = 1 then a.intensity else s.area end as auc
        from grid g left join apex a using (target_id, file)
        left join (
            select target_id, file, count(*) as n, sum((rt - rt0) * (intensity + i0) / 2) as area
            from (select *, lag(rt) over w as rt0, lag(intensity) over w as i0 from eic
                  window w as (partition by target_id, file order by rt))
            group by target_id, file) s using (target_id, file)""",
    "hit": """
        select target_id, molecule, target_mz, file, rt, scanid, max(intensity) as max_intensity,
               avg(mz) as mean_mz, count(*) as n_points
        from matched where intensity >= 90000 and rt between 0 and 30 group by all""",
    "screened": """
        select g.file as "Sample", g.molecule as "Compound", round(g.target_mz, 6) as "Exact_Mass",
               round(h.mz, 9) as "Observed_MZ",
               round((h.mz - g.target_mz) / g.target_mz * 1e6, 6) as "MZ_Error_ppm",
               least(cast(100 as double), coalesce(h.n, 0) / cast(10 as double) * 100) as "Detection_Score",
               coalesce(h.top, 0) as "Max_Intensity", coalesce(h.n, 0) as "N_Detections",
               case when h.n is null then 'Not Detected'
                    when least(100, h.n / cast(10 as double) * 100) > 50 then 'Detected'
                    else 'Tentative' end as "Status"
        from grid g left join (
            select target_id, file, count(*) as n, max(max_intensity) as top, avg(mean_mz) as mz
            from hit group by target_id, file) h using (target_id, file)""",
    "processed": """
        select m.target_id, m.molecule, m.file, d.display_name, d.date_order, m.max_intensity, m.rt_at_max,
               row_number() over (partition by m.molecule order by d.date_order nulls last, m.file) as sample_idx
        from mx m join dated d using (file)
        where m.max_intensity > 0
          and not regexp_matches(m.file, '(?i)(blanc|reference|pool|cal|SST)')""",
    "scans": """
        select t.target_id, t.name as molecule, p.file, p.rt, p.scanid, sum(p.intensity) as intensity
        from peaks p join molecules t
          on p.mz between t.mz - cast(0.01 as double) and t.mz + cast(0.01 as double)
        where p.mslevel = '1' group by all""",
    "centre": """
        select target_id, molecule, file, rt as apex_rt from (
            select *, row_number() over (partition by target_id, file order by intensity desc, rt) as place
            from scans) where place = 1""",
    "near": """
        select s.*, c.apex_rt, max(s.intensity) over (partition by s.target_id, s.file) as top
        from scans s join centre c using (target_id, file)
        where s.rt between c.apex_rt - 0.5 and c.apex_rt + 0.5""",
    "apex_window": """
        select target_id, molecule, file, apex_rt, count(*) as n_near,
               case when count(*) > 3 and max(rt) filter (intensity > top / 2) is not null
                    then greatest(cast(0.05 as double), max(rt) filter (intensity > top / 2)
                                  - min(rt) filter (intensity > top / 2))
                    else cast(0.1 as double) end as rt_tolerance
        from near group by target_id, molecule, file, apex_rt""",
    "box": """
        select molecule, target_id, file, log10(max_intensity + 1) as value from mx""",
    "pair": """
        select a.name as name_1, b.name as name_2 from molecules a join molecules b on a.target_id < b.target_id""",
    "diff": """
        select p.name_1, p.name_2, a.file, a.value - b.value as d
        from pair p join box a on a.molecule = p.name_1
        join box b on b.molecule = p.name_2 and b.file = a.file""",
    "profile": """
        select molecule, file, value from box""",
    "kept_box": """
        select b.molecule, b.file, b.value from box b
        where b.value > 0 and not regexp_matches(b.file, '(?i)(blanc|reference|pool|cal|SST)')""",
    "kept_profile": """
        select m.molecule, f.file, coalesce(k.value, 0) as value
        from (select distinct molecule from kept_box) m, (select distinct file from kept_box) f
        left join kept_box k on k.molecule = m.molecule and k.file = f.file""",
    "kept_pair": """
        select a.file as item_1, b.file as item_2, sqrt(sum((a.value - b.value) * (a.value - b.value))) as distance
        from kept_profile a join kept_profile b on a.molecule = b.molecule and a.file < b.file
        group by a.file, b.file""",
    "given": """
        select t.target_id, t.name as molecule, f.file, r.rt as apex_rt
        from manifest f, molecules t, (select unnest([cast(1 as double), cast(2.5 as double), cast(9 as double)]) as rt) r""",
    "given_near": """
        select g.*, s.rt, s.intensity, max(s.intensity) over (partition by g.target_id, g.file, g.apex_rt) as top
        from given g join scans s on s.target_id = g.target_id and s.file = g.file
         and s.rt between g.apex_rt - 0.5 and g.apex_rt + 0.5""",
    "given_window": """
        select g.target_id, g.molecule, g.file, g.apex_rt, count(n.rt) as n_near,
               case when count(n.rt) > 3 and max(n.rt) filter (n.intensity > n.top / 2) is not null
                    then greatest(cast(0.05 as double), max(n.rt) filter (n.intensity > n.top / 2)
                                  - min(n.rt) filter (n.intensity > n.top / 2))
                    else cast(0.1 as double) end as rt_tolerance
        from given g left join given_near n using (target_id, file, apex_rt)
        group by g.target_id, g.molecule, g.file, g.apex_rt""",
    "sample_pair": """
        select a.file as item_1, b.file as item_2, sqrt(sum((a.value - b.value) * (a.value - b.value))) as distance
        from profile a join profile b on a.molecule = b.molecule and a.file < b.file
        group by a.file, b.file""",
}

# Which parts a part is built on.
_NEEDS = {
    "metadata": ["named"],
    "latest": ["metadata"],
    "decoded": ["latest"],
    "dated": ["manifest", "latest", "decoded"],
    "matched": ["peaks", "molecules"],
    "eic": ["matched"],
    "grid": ["manifest", "molecules"],
    "apex": ["eic"],
    "mx": ["grid", "apex"],
    "summary": ["grid", "apex", "eic"],
    "hit": ["matched"],
    "screened": ["grid", "hit"],
    "processed": ["mx", "dated"],
    "scans": ["peaks", "molecules"],
    "centre": ["scans"],
    "near": ["scans", "centre"],
    "apex_window": ["near"],
    "box": ["mx"],
    "pair": ["molecules"],
    "diff": ["pair", "box"],
    "profile": ["box"],
    "sample_pair": ["profile"],
    "kept_box": ["box"],
    "kept_profile": ["kept_box"],
    "kept_pair": ["kept_profile"],
    "given": ["manifest", "molecules"],
    "given_near": ["given", "scans"],
    "given_window": ["given", "given_near"],
}


def _with(parts: list[str], query: str, **replaced: str) -> str:
    ordered: list[str] = []

    def add(part: str) -> None:
        for needed in _NEEDS.get(part, []):
            add(needed)
        if part not in ordered:
            ordered.append(part)

    for part in parts:
        add(part)
    texts = {**_PARTS, **replaced}
    return "with " + ",\n".join(f"{part} as ({texts[part]})" for part in ordered) + "\n" + query


_EIC_COLUMNS = "molecule, file, rt, round(intensity, 2) as intensity, target_mz"

_ONE_MASS = """
    select file, rt, sum(intensity) as intensity from peaks
    where mslevel = '1' and intensity >= {floor}
      and mz between cast(155.0523 as double) - cast(0.01 as double)
                 and cast(155.0523 as double) + cast(0.01 as double)
    group by file, rt"""

_DATE_LABEL = """case
    when regexp_matches({name}, 'E-[0-9]{{4}}_[0-9]{{2}}')
        then replace(substring(regexp_extract({name}, 'E-[0-9]{{4}}_[0-9]{{2}}'), 3, 7), '_', '-')
    when regexp_matches({name}, '20[12][0-9][-_][0-9]{{2}}')
        then replace(regexp_extract({name}, '20[12][0-9][-_][0-9]{{2}}'), '_', '-')
    when regexp_matches({name}, '20[12][0-9]') then regexp_extract({name}, '20[12][0-9]')
    else substring({name}, 1, 10) end"""


def _metadata_label(name: str) -> str:
    """Scalar expression over a row with `name`, joined to `decoded` as a and b."""
    return f"""case
        when a.key is not null and a.year is not null and a.month is not null
            then format('{{}}-{{:02d}}', a.year, a.month)
        when a.key is null and b.year is not null and b.month is not null
            then format('{{}}-{{:02d}}', b.year, b.month)
        else {_DATE_LABEL.format(name=name)} end"""


def _label_joins(name: str) -> str:
    return f"""left join decoded a on a.key = url_decode({name})
        left join decoded b
          on b.key = regexp_replace(url_decode({name}), '^E-[0-9]{{4}}_[0-9]{{2}}-', '')"""


def _evenly(samples: int) -> str:
    """Files at evenly spaced positions of the manifest."""
    return f"""
        select file from (select file, row_number() over (order by pos) as place,
                                 count(*) over () as n from manifest)
        where n <= {samples} or place in (
            select round_even(1 + i * ((select count(*) from manifest) - 1) / cast({samples - 1} as double), 0)
            from range({samples}) r(i))"""


def _heat(value: str) -> str:
    return _with(["summary"], f"select molecule, file, round({value}, 6) as value from summary")


def _spectrum(mslevel: str) -> str:
    return _with(
        ["apex_window"],
        f"""
        , lines as (
            select w.molecule, w.file, p.mz, sum(p.intensity) as intensity
            from apex_window w join peaks p on p.file = w.file
             and p.rt between w.apex_rt - w.rt_tolerance and w.apex_rt + w.rt_tolerance
            where p.mslevel = '{mslevel}' group by w.molecule, w.file, p.mz)
        select molecule, file, mz, round(intensity, 2) as intensity,
               round(max(intensity) over (partition by molecule, file), 2) as base_peak
        from lines""",
    )


def _given_spectrum(mslevel: str) -> str:
    return _with(
        ["given_window", "peaks"],
        f"""
        , lines as (
            select w.molecule, w.file, w.apex_rt, p.mz, sum(p.intensity) as intensity
            from given_window w join peaks p on p.file = w.file
             and p.rt between w.apex_rt - w.rt_tolerance and w.apex_rt + w.rt_tolerance
            where p.mslevel = '{mslevel}' group by all)
        select molecule, file, apex_rt, mz, round(intensity, 2) as intensity,
               round(max(intensity) over (partition by molecule, file, apex_rt), 2) as base_peak
        from lines""",
    )


def _nearest(pairs: str) -> str:
    return f"""
        select item, other as nearest, round(distance, 6) as distance from (
            select *, row_number() over (partition by item order by distance, other) as place from (
                select item_1 as item, item_2 as other, distance from {pairs}
                union all select item_2, item_1, distance from {pairs}))
        where place = 1"""


def _nearest_k(pairs: str, k: int) -> str:
    return f"""
        select item, cast(place as int) as rank, other as nearest, round(distance, 6) as distance from (
            select *, row_number() over (partition by item order by round(distance, 9), other) as place from (
                select item_1 as item, item_2 as other, distance from {pairs}
                union all select item_2, item_1, distance from {pairs}))
        where place <= {k}"""


def _wide(cells: str) -> str:
    columns = ", ".join(f"coalesce(round(sum(value) filter (molecule = 'mol_{i}'), 6), 0) as mol_{i}" for i in range(5))
    return f"select file, {columns} from {cells} group by file"


def _molecule_distance(profile: str) -> str:
    return f"""
        select a.molecule as item_1, b.molecule as item_2,
               round(sqrt(sum((a.value - b.value) * (a.value - b.value))), 6) as distance
        from {profile} a join {profile} b on a.file = b.file and a.molecule < b.molecule
        group by a.molecule, b.molecule"""


def _tree(known: str, query: str) -> str:
    """`query` over the complete-linkage tree of `known` (i, j, name_i, name_j, distance; i < j): merge by merge.

    A cluster is named after its first item. The least (distance, first item, first item) merges next.
    """
    return f"""
        with recursive known as ({known}),
        name as (select distinct i, name_i as item from known union select distinct j, name_j from known),
        state as (
            select cast(1 as bigint) as step, i as lo, j as hi, distance as d from known
            union all
            select step + 1, lo, hi, max(d) from (
                select step, least(x, y) as lo, greatest(x, y) as hi, d from (
                    select step, d, case when lo = b then a else lo end as x, case when hi = b then a else hi end as y
                    from (select *, first_value(lo) over w as a, first_value(hi) over w as b from state
                          window w as (order by d, lo, hi)))
                where x <> y)
            group by step, lo, hi),
        merge as (select * from state qualify row_number() over (partition by step order by d, lo, hi) = 1),
        child as (
            select m.step, m.lo, m.hi,
                   (select max(x.step) from merge x where x.lo = m.lo and x.step < m.step) as lo_step,
                   (select max(x.step) from merge x where x.lo = m.hi and x.step < m.step) as hi_step
            from merge m),
        side as (
            select step, lo as label, lo_step as below, coalesce(lo_step, 0) <= coalesce(hi_step, 0) as first from child
            union all
            select step, hi, hi_step, coalesce(lo_step, 0) > coalesce(hi_step, 0) from child),
        node as (
            select max(step) as step, cast(null as bigint) as leaf, '' as path from merge
            union all
            select s.below, case when s.below is null then s.label end, concat(n.path, case when s.first then '0' else '1' end)
            from node n join side s on s.step = n.step),
        leaf as (select leaf as i, path, row_number() over (order by path) as place from node where leaf is not null)
        {query}"""


def _distances(item: str, other: str, place: str) -> str:
    return f"""
        , placed as (select item_name as item, row_number() over (order by {place}, item_name) as i from
                     (select distinct {item} as item_name from profile) left join manifest m on m.file = item_name),
        valued as (select i, p.{item} as item, p.{other} as other, value from profile p join placed on placed.item = p.{item})
        select a.i, b.i as j, a.item as name_i, b.item as name_j,
               round(sqrt(sum((a.value - b.value) * (a.value - b.value))), 9) as distance
        from valued a join valued b on a.other = b.other and a.i < b.i group by all"""


_TREE_OF = {"molecule": _distances("molecule", "file", "cast(0 as bigint)"), "file": _distances("file", "molecule", "pos")}

_LEAVES = """
    select item as {name}, place, round((select min(d) from merge where lo = i or hi = i), 6) as height
    from leaf join name using (i)"""

_MERGES = """
    select m.step, a.item as a, b.item as b, round(m.d, 6) as height,
           (select count(*) from leaf join node n on n.step = m.step and starts_with(leaf.path, n.path)) as n_items
    from merge m join name a on a.i = m.lo join name b on b.i = m.hi"""


# Mid-ranks of `value` over each pair, as 1 + smaller values + half the other equals.
_MID = """rank() over (partition by name_1, name_2 order by {value})
          + (count(*) over (partition by name_1, name_2, {value}) - 1) / cast(2 as double)"""
_TIE = "count(*) over (partition by name_1, name_2, {value})"


def _steps(n: int) -> str:
    """Places k / n with the weights of Simpson's rule."""
    return f"""
        select k / cast({n} as double) as x, 1 / cast({3 * n} as double)
               * case when k in (0, {n}) then 1 when k % 2 = 1 then 4 else 2 end as w
        from range({n + 1}) r(k)"""


# Both tails of the normal distribution beyond z: its density there times the integral of exp(-z t - t^2 / 2).
_NORMAL_TAILS = """least(1, 2 * exp(-any_value(z) * any_value(z) / 2) / sqrt(2 * pi())
    * sum(w * 12 * exp(-z * 12 * x - 72 * x * x)))"""

# With t = sqrt(df) tan(a), the density of t becomes cos(a)^(df - 1), and the share of it beyond t needs no constant.
_STUDENT_TAILS = """sum(w * (pi() / 2 - atan(abs(statistic) / sqrt(df)))
        * pow(cos(atan(abs(statistic) / sqrt(df)) + x * (pi() / 2 - atan(abs(statistic) / sqrt(df)))), df - 1))
    / sum(w * pi() / 2 * pow(cos(x * pi() / 2), df - 1))"""


def statements() -> dict[str, str]:
    eic_columns = f"select {_EIC_COLUMNS}"
    library_match = _PARTS["matched"].replace("molecules t", "library t")
    library_grid = _PARTS["grid"].replace("molecules t", "library t")
    sql = {
        "eic_single_target": _with(
            ["peaks"],
            "select file, rt, round(intensity, 2) as intensity, cast(155.0523 as double) as target_mz"
            f" from ({_ONE_MASS.format(floor=0)}) where rt between 0 and 30",
        ),
        "eic_dataset": _with(
            ["peaks", "manifest"],
            "select f.file, f.pos, e.rt, round(e.intensity, 2) as intensity,"
            " case when e.rt is not null then cast(155.0523 as double) end as target_mz"
            f" from manifest f left join ({_ONE_MASS.format(floor=0)}) e on e.file = f.file",
        ),
        "eic_rt_range": _with(
            ["matched"],
            f"{eic_columns} from (select molecule, target_mz, file, rt, sum(intensity) as intensity"
            " from matched where rt between 1 and 3 and intensity >= 20000 group by all)",
        ),
        "eic_multi_molecule": _with(["eic"], f"{eic_columns} from eic"),
        "eic_multi_molecule_binned": _with(["eic"], f"{eic_columns} from eic"),
        "eic_library": _with(["library", "eic"], f"{eic_columns} from eic", matched=library_match),
        "eic_per_scan": _with(
            ["scans"],
            "select s.molecule, s.file, s.rt, s.scanid, round(s.intensity, 2) as intensity,"
            " m.mz as target_mz from scans s join molecules m using (target_id)",
        ),
        "eic_overlay_subsample": _with(
            ["eic", "manifest"], f"{eic_columns} from eic where file in ({_evenly(8)})"
        ),
        "eic_compare": _with(
            ["eic", "manifest"],
            f"{eic_columns}, concat(molecule, '_', file) as trace from eic"
            f" where molecule in ('mol_0', 'mol_2') and rt between 1 and 4 and file in ({_evenly(25)})",
        ),
        "eic_faceted": _with(["eic"], f"{eic_columns}, file as facet from eic"),
        "hits": _with(
            ["hit"],
            "select molecule, file, rt, scanid, max_intensity, round(mean_mz, 9) as mean_mz, n_points from hit",
        ),
        "suspect_screening": _with(["screened"], "select * from screened"),
        "suspect_screening_rounded": _with(
            ["grid", "hit"],
            """
            select g.file as "Sample", g.molecule as "Compound", g.target_mz as "Exact_Mass",
                   round_even(least(cast(100 as double), coalesce(h.n, 0) / cast(10 as double) * 100), 1) as "Detection_Score",
                   round_even(coalesce(h.top, 0), 0) as "Max_Intensity", coalesce(h.n, 0) as "N_Detections",
                   case when h.n is null then 'Not Detected'
                        when least(100, h.n / cast(10 as double) * 100) > 50 then 'Detected' else 'Tentative' end as "Status"
            from grid g left join (
                select target_id, file, count(*) as n, max(max_intensity) as top, avg(mean_mz) as mz
                from hit group by target_id, file) h using (target_id, file)""",
        ),
        "suspect_screening_library": _with(
            ["library", "screened"], "select * from screened", matched=library_match, grid=library_grid
        ),
        "detected_compounds": _with(
            ["screened"], 'select distinct "Compound" from screened where "Detection_Score" > 0'
        ),
        "batch_summary": _with(
            ["summary"],
            "select molecule, file, detected, round(max_intensity, 2) as max_intensity, rt_at_max,"
            " n_points, round(auc, 6) as auc from summary",
        ),
        "max_intensities": _with(
            ["mx"],
            "select molecule, file, round(max_intensity, 2) as max_intensity, rt_at_max, target_mz from mx",
        ),
        "heatmap_max": _heat("log10(max_intensity + 1)"),
        "heatmap_auc": _heat("log10(auc + 1)"),
        "heatmap_detected": _heat("cast(cast(detected as int) as double)"),
        "metadata_latest": _with(["latest"], "select name, year, month from latest"),
        "date_labels_from_name": _with(
            ["manifest"], f"select file, {_DATE_LABEL.format(name='file')} as date_label from manifest"
        ),
        "date_labels_from_metadata": _with(
            ["manifest", "decoded"],
            f"select f.file, {_metadata_label('f.file')} as date_label from manifest f {_label_joins('f.file')}",
        ),
        "reorder_by_date": _with(
            ["dated"],
            "select file, year, month, date_order, display_name,"
            " row_number() over (order by date_order nulls last, file) as sample_idx from dated",
        ),
        "date_span": _with(
            ["dated"],
            "select min(date_order) // 100 as min_year, min(date_order) % 100 as min_month,"
            " max(date_order) // 100 as max_year, max(date_order) % 100 as max_month from dated",
        ),
        "filter_samples": _with(
            ["manifest"],
            "select file, pos from manifest"
            " where not regexp_matches(file, '(?i)(blanc|reference|pool|cal|SST)')",
        ),
        "filter_sample_paths": _with(
            ["manifest"],
            "select file, pos from manifest where not regexp_matches(file, '(?i)(blanc|reference|pool|cal)')",
        ),
        "missing_files": _with(
            ["peaks", "manifest"],
            "select file, pos from manifest"
            f" where file not in (select file from ({_ONE_MASS.format(floor=90000)}))",
        ),
        "run_counters": _with(
            ["mx", "dated"],
            """
            select m.molecule, count(*) filter (not m.out) as n_kept, count(*) filter (m.out) as n_excluded,
                   count(*) filter (not m.out and d.date_order is null) as n_unmatched,
                   count(*) filter (not m.out and m.max_intensity <= 0) as n_zero,
                   count(*) filter (s.max_intensity > 0) as n_normalised, count(*) as n_samples
            from (select *, regexp_matches(file, '(?i)(blanc|reference|pool|cal|SST)') as out from mx) m
            join dated d using (file)
            join (select file, max_intensity from mx where molecule = 'mol_3') s using (file)
            group by m.molecule""",
        ),
        "process_screening_results": _with(
            ["processed"],
            "select molecule, file, display_name, sample_idx, round(max_intensity, 2) as max_intensity,"
            " rt_at_max from processed",
        ),
        "normalize_by_istd": _with(
            ["mx"],
            """
            select m.file, round(m.max_intensity / s.max_intensity, 9) as max_intensity,
                   round(m.max_intensity, 2) as max_intensity_mol,
                   round(s.max_intensity, 2) as max_intensity_istd,
                   m.rt_at_max, s.rt_at_max as rt_at_max_istd, m.target_mz, s.target_mz as target_mz_istd,
                   'mol_0' as molecule, 'mol_3' as istd
            from mx m join mx s using (file)
            where m.molecule = 'mol_0' and s.molecule = 'mol_3'
              and m.max_intensity > 0 and s.max_intensity > 0""",
        ),
        "normalized_line": _with(
            ["processed"],
            """
            select 'mol_0' as molecule, m.file, m.display_name, m.date_order, m.sample_idx, m.display_name as tick,
                   round(m.max_intensity / s.max_intensity, 9) as plot_intensity
            from processed m join processed s using (file)
            where m.molecule = 'mol_0' and s.molecule = 'mol_3'""",
        ),
        "combined_stripes": _with(
            ["mx"],
            """
            , stacked as (
                select 'Raw' as molecule, 0 as molecule_ord, file, pos, log10(max_intensity + 1) as value
                from mx where molecule = 'mol_0'
                union all
                select 'Normalised', 1, m.file, m.pos, log10(m.max_intensity / s.max_intensity + 1)
                from mx m join mx s using (file)
                where m.molecule = 'mol_0' and s.molecule = 'mol_3' and m.max_intensity > 0 and s.max_intensity > 0)
            select molecule, molecule_ord, file, row_number() over (partition by molecule order by pos) as sample_idx,
                   round(value, 9) as plot_intensity, round(median(value) over (partition by molecule), 9) as midpoint
            from stacked""",
        ),
        "combine_molecules": _with(
            ["mx"],
            "select case molecule when 'mol_1' then 'First' else 'Second' end as molecule, file,"
            " round(max_intensity, 2) as max_intensity, rt_at_max from mx where molecule in ('mol_1', 'mol_2')",
        ),
        "apex_rt_tolerance": _with(
            ["apex_window"],
            "select molecule, file, apex_rt, n_near, round(rt_tolerance, 9) as rt_tolerance from apex_window",
        ),
        "spectrum_at_apex_ms1": _spectrum("1"),
        "spectrum_at_apex_ms2": _spectrum("2"),
        "given_rt_windows": _with(
            ["given_window"],
            "select molecule, file, apex_rt, n_near, round(rt_tolerance, 9) as rt_tolerance from given_window",
        ),
        "spectrum_at_given_rt_ms1": _given_spectrum("1"),
        "spectrum_at_given_rt_ms2": _given_spectrum("2"),
        "spectrum_rt_range": _with(
            ["peaks"],
            "select file, mz, round(sum(intensity), 2) as intensity from peaks"
            " where mslevel = '2' and rt between 1 and cast(2.5 as double) group by file, mz",
        ),
        "stripes": _with(
            ["mx", "decoded"],
            f"""
            , placed as (
                select m.molecule, m.file, log10(m.max_intensity + 1) as value,
                       row_number() over (partition by m.molecule order by m.pos) as sample_idx,
                       {_metadata_label('m.file')} as date_label
                from mx m {_label_joins('m.file')})
            select molecule, file, sample_idx, date_label,
                   case when row_number() over (partition by molecule, date_label order by sample_idx) = 1
                        then date_label end as tick,
                   round(value, 6) as plot_intensity,
                   round(median(value) over (partition by molecule), 6) as midpoint
            from placed""",
        ),
        "interactive_stripes": _with(
            ["mx", "decoded"],
            f"""
            , placed as (
                select m.molecule, m.file, log10(m.max_intensity + 1) as value,
                       row_number() over (partition by m.molecule order by m.pos) as sample_idx,
                       {_metadata_label('m.file')} as date_label
                from mx m {_label_joins('m.file')}),
            ranged as (
                select *, min(value) over (partition by molecule) as low, max(value) over (partition by molecule) as high
                from placed)
            select molecule, file, sample_idx, date_label,
                   case when row_number() over (partition by molecule, date_label order by sample_idx) = 1
                        then date_label end as tick,
                   round(value, 6) as plot_intensity,
                   cast(greatest(1, ceil((value - low) / (high - low + 1e-10) * 100)) as bigint) as bucket
            from ranged""",
        ),
        "stripes_color_bucket": _with(
            ["box"],
            """
            select molecule, file, cast(greatest(1, ceil((value - low) / (high - low + 1e-10) * 100)) as bigint)
                   as bucket
            from box join (select molecule, min(value) as low, max(value) as high from box group by molecule)
            using (molecule)""",
        ),
        "intensity_line": _with(
            ["processed", "decoded"],
            f"""
            , labelled as (
                select p.*, split_part({_metadata_label('p.display_name')}, '-', 1) as date_label
                from processed p {_label_joins('p.display_name')})
            select molecule, display_name, sample_idx, date_label,
                   case when row_number() over (partition by molecule, date_label order by sample_idx) = 1
                        then date_label end as tick,
                   round(log10(max_intensity + 1), 6) as plot_intensity
            from labelled""",
        ),
        "multi_stripes_matrix": _with(
            ["box"], "select molecule, file, round(value, 6) as plot_intensity from box"
        ),
        "multi_stripes_wide": _with(["box"], _wide("box")),
        "multi_stripes_wide_processed": _with(["kept_box"], _wide("kept_box")),
        "molecule_distance": _with(["profile"], _molecule_distance("profile")),
        "molecule_distance_processed": _with(["kept_profile"], _molecule_distance("kept_profile")),
        "sample_distance": _with(
            ["sample_pair"], "select item_1, item_2, round(distance, 6) as distance from sample_pair"
        ),
        "cluster_order_molecules": _tree(_with(["profile"], _TREE_OF["molecule"]), _LEAVES.format(name="molecule")),
        "cluster_order_samples": _tree(_with(["profile"], _TREE_OF["file"]), _LEAVES.format(name="file")),
        "cluster_merges_samples": _tree(_with(["profile"], _TREE_OF["file"]), _MERGES),
        "nearest_profile": _with(["sample_pair"], _nearest("sample_pair")),
        "nearest_k_profiles": _with(["sample_pair"], _nearest_k("sample_pair", 5)),
        "nearest_k_profiles_processed": _with(["kept_pair"], _nearest_k("kept_pair", 5)),
        "nearest_profile_processed": _with(["kept_pair"], _nearest("kept_pair")),
        "box_compare_frame": _with(["box"], "select molecule, file, round(value, 6) as value from box"),
        "box_stats": _with(
            ["box"],
            """
            , quart as (
                select molecule, quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.5) as median,
                       quantile_cont(value, 0.75) as q3 from box group by molecule),
            marked as (
                select b.molecule, b.value, q.q1, q.median, q.q3,
                       b.value between q.q1 - 1.5 * (q.q3 - q.q1) and q.q3 + 1.5 * (q.q3 - q.q1) as inside
                from box b join quart q using (molecule))
            select molecule, round(q1, 6) as q1, round(median, 6) as median, round(q3, 6) as q3,
                   count(*) as n, round(min(value) filter (inside), 6) as whisker_low,
                   round(max(value) filter (inside), 6) as whisker_high,
                   count(*) filter (not inside) as n_outliers
            from marked group by molecule, marked.q1, marked.median, marked.q3""",
        ),
        "wilcoxon_signed_rank_stat": _with(
            ["diff"],
            f"""
            , ranked as (
                select name_1, name_2, d, {_MID.format(value='abs(d)')} as r, {_TIE.format(value='abs(d)')} as t
                from diff where d <> 0)
            select p.name_1, p.name_2, coalesce(sum(r) filter (d > 0), 0) as statistic, count(r.d) as n,
                   (select count(*) from diff z where z.name_1 = p.name_1 and z.name_2 = p.name_2 and z.d = 0)
                   as zeros,
                   coalesce(sum(cast(t * t - 1 as double)), 0) as ties
            from pair p left join ranked r using (name_1, name_2) group by p.name_1, p.name_2""",
        ),
        "rank_sum_stat": _with(
            ["pair", "box"],
            f"""
            , sides as (
                select p.name_1, p.name_2, b.value, 1 as side from pair p join box b on b.molecule = p.name_1
                union all
                select p.name_1, p.name_2, b.value, 2 from pair p join box b on b.molecule = p.name_2),
            ranked as (
                select name_1, name_2, side, {_MID.format(value='value')} as r, {_TIE.format(value='value')} as t
                from sides)
            select name_1, name_2,
                   sum(r) filter (side = 1) - count(*) filter (side = 1)
                       * (count(*) filter (side = 1) + 1) / cast(2 as double) as statistic,
                   count(*) filter (side = 1) as n_1, count(*) filter (side = 2) as n_2,
                   sum(cast(t * t - 1 as double)) as ties
            from ranked group by name_1, name_2""",
        ),
        "t_test_paired": _with(
            ["diff"],
            """
            select name_1, name_2, round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 6) as statistic,
                   cast(count(*) - 1 as double) as df, round(avg(d), 6) as mean_difference
            from diff group by name_1, name_2""",
        ),
        "t_test_welch": _with(
            ["pair", "box"],
            """
            , side as (
                select molecule, avg(value) as m, var_samp(value) / count(*) as e, count(*) as n
                from box group by molecule)
            select name_1, name_2, round((a.m - b.m) / sqrt(a.e + b.e), 6) as statistic,
                   round((a.e + b.e) * (a.e + b.e) / (a.e * a.e / (a.n - 1) + b.e * b.e / (b.n - 1)), 6) as df,
                   round(a.m, 6) as mean_1, round(b.m, 6) as mean_2
            from pair join side a on a.molecule = name_1 join side b on b.molecule = name_2""",
        ),
    }
    sql["one_sample_only"] = _with(["eic"], f"{eic_columns} from eic where file = 'POOL_2023%201.parquet'")
    sql["results_by_score"] = f"""
        select row_number() over (order by "Detection_Score" desc, "Compound", "Sample") as place,
               "Sample", "Compound", "Detection_Score", "Status"
        from ({sql['suspect_screening_rounded']})"""
    sql["manifest_listing"] = f"""
        with named as (
            select s_suppkey as k, {_file('s_suppkey')} as sample,
                   case when s_suppkey % 4 = 0 then '' when s_suppkey % 4 = 1 then 'batch/' else 'batch/part two/' end as place
            from supplier),
        listed as (
            select k, place, case when k % 5 = 4 then replace(sample, '.parquet', '.csv')
                                  when k % 7 = 2 then upper(sample) else sample end as file from named),
        kept as (
            select file, concat(place, file) as path, case when place = '' then '.' else rtrim(place, '/') end as folder,
                   case when k % 2 = 0 then concat('file:///data/', place, file) end as url
            from listed where k % 11 <> 0 and lower(file) like '%.parquet')
        select row_number() over (order by path) as place,
               coalesce(replace(url, 'file:///', '/'), concat(folder, '/', file)) as file_id, file, path, folder, url
        from kept"""
    sql["metadata_from_text"] = """
        with parsed as (
            select concat('sample ', s_suppkey % 9) as name, 1000000 - s_suppkey as pos,
                   case when s_suppkey % 5 <> 0 and (s_suppkey % 7 = 0 or s_suppkey % 13 = 0) then null
                        else cast(2019 + s_suppkey % 3 as int) end as year,
                   case when s_suppkey % 4 <> 0 then cast(1 + s_suppkey % 12 as int) end as month
            from supplier)
        select name, year, month from parsed
        qualify row_number() over (partition by name order by year desc nulls last, pos) = 1"""
    sql["run_counters_observed"] = sql["run_counters"]
    sql["incremental_max_frame"] = sql["max_intensities"]
    sql["spectrum_from_time_layout"] = sql["spectrum_at_apex_ms2"]
    exact = lambda text: text.replace("round(", "(").replace(", 6)", ")")
    sql["pairwise_tests"] = f"""
        with signed as ({sql['wilcoxon_signed_rank_stat']}),
        ranks as ({sql['rank_sum_stat']}),
        paired as ({exact(sql['t_test_paired'])}),
        welch as ({exact(sql['t_test_welch'])}),
        shifted as (
            select name_1, name_2, 'wilcox.test' as method, true as paired, statistic,
                   statistic - n * (n + 1) / 4.0 as shift, n * (n + 1) * (2 * n + 1) / 24.0 - ties / 48 as variance
            from signed
            union all
            select name_1, name_2, 'wilcox.test', false, statistic, statistic - n_1 * n_2 / 2.0,
                   n_1 * n_2 / 12.0 * (n_1 + n_2 + 1 - ties / ((n_1 + n_2) * (n_1 + n_2 - 1.0)))
            from ranks),
        normal as (
            select *, (abs(shift) - case when shift <> 0 then 0.5 else 0 end) / sqrt(variance) as z from shifted),
        student as (
            select name_1, name_2, 't.test' as method, true as paired, statistic, df from paired
            union all select name_1, name_2, 't.test', false, statistic, df from welch),
        tests as (
            select name_1, name_2, method, paired, statistic, {_NORMAL_TAILS} as p
            from normal, ({_steps(6000)}) s group by all
            union all
            select name_1, name_2, method, paired, statistic, {_STUDENT_TAILS} as p
            from student, ({_steps(40000)}) s group by name_1, name_2, method, paired, statistic, df)
        select name_1, name_2, method, paired, round(statistic, 6) as statistic, round(p, 6) as p,
               case when p <= 1e-4 then '****' when p <= 1e-3 then '***' when p <= 0.01 then '**'
                    when p <= 0.05 then '*' when p is not null then 'ns' end as p_signif,
               case when p < 2.2e-16 then 'p < 2.2e-16'
                    when p < 1e-4 then concat('p = ', replace(format('{{:.1e}}', p), '.0e', 'e'))
                    when p is not null then concat('p = ', format('{{:.2g}}', p)) end as p_format
        from tests"""
    for name, method, paired in (
        ("wilcoxon_signed_rank_stat", "wilcox.test", "true"),
        ("rank_sum_stat", "wilcox.test", "false"),
        ("t_test_paired", "t.test", "true"),
        ("t_test_welch", "t.test", "false"),
    ):
        sql[name] = f"""
            select s.*, t.p from ({sql[name]}) s
            join (select name_1, name_2, p from ({sql['pairwise_tests']}) where method = '{method}' and paired = {paired}) t
            using (name_1, name_2)"""
    return sql
