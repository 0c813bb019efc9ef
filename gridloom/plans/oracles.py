"""The same results as DuckDB SQL."""

from __future__ import annotations

_PROMO = "select distinct l_orderkey as image_id from lineitem join part on l_partkey = p_partkey join orders on l_orderkey = o_orderkey where p_type = 'PROMO' and l_extendedprice / o_totalprice >= 0.1::double"
_STRATA = """select distinct case when p_type in ('SMALL', 'MEDIUM') then 'similar' else 'different' end as stratum, l_orderkey as image_id from lineitem join part on l_partkey = p_partkey
  where p_type in ('SMALL', 'MEDIUM', 'LARGE', 'ECONOMY') and l_orderkey not in (select l_orderkey from lineitem join part on l_partkey = p_partkey where p_type = 'PROMO')"""
_SAMPLED = f"select stratum, image_id from (select *, row_number() over (partition by stratum order by md5('negatives:' || stratum || ':' || image_id), image_id) as n from ({_STRATA})) where n <= 50"
_TILES = """select p_partkey as image_id, (p_size + 9)::int as width, (p_size * 2 + 7)::int as height, i::int as "index",
  ((i % 3) * ((p_size + 9) // 3))::int as x_min, ((i // 3) * ((p_size * 2 + 7) // 3))::int as y_min, ((i % 3 + 1) * ((p_size + 9) // 3))::int as x_max, ((i // 3 + 1) * ((p_size * 2 + 7) // 3))::int as y_max
  from part, range(9) t(i)"""
_P = """select vec_id, i::int as class_idx, exp(x - max(x) over (partition by vec_id)) / sum(exp(x - m)) over (partition by vec_id) as p
  from (select *, max(x) over (partition by vec_id) as m from (select vec_id, i, embedding[i + 1]::double * 10 as x from embeddings, range(64) t(i)))"""
_VOCABULARY = """(select k::int as class_idx, case when k < 10 then (['school bus', 'minibus', 'trolleybus', 'sports car', 'traffic light', 'mountain bike', 'cabinet', 'hydrant', 'dog', 'tandem'])[k + 1]
    else (['jeep', 'house', 'tandem bicycle', 'tree', 'taxi', 'lamp', 'fire hydrant', 'omnibus'])[k % 8 + 1] || ' ' || k end as label from range(64) t(k)) v"""
_CATEGORIES = f"""(select class_idx, cat from (select class_idx, unnest([case when contains(label, 'bus') then 'bus' end, case when regexp_matches(label, 'car|cab|taxi|limousine|jeep|minivan|pickup|racer|ambulance|police van') then 'car' end,
    case when contains(label, 'traffic light') then 'traffic_light' end, case when regexp_matches(label, 'bicycle|mountain bike|tandem') then 'bicycle' end, case when contains(label, 'hydrant') then 'fire_hydrant' end]) as cat from {_VOCABULARY}) where cat is not null)"""
_EPOCHS = "select event_id % 40 as epoch, round(avg(case when event_type = 'click' then 1::double else 0::double end), 3) as val_acc from events group by 1"
_PIXELS = """select p_partkey as image, (k // 36)::int as y, (k // 3 % 12)::int as x, (k % 3)::int as c, ((k * 7 + p_size * k % 31 + p_partkey * 13) % 256)::int as v
  from part, range(324) t(k)"""
_PARTS = "case when p_partkey % 3 = 0 then format('{:012d}_original.jpg', p_partkey) when p_partkey % 3 = 1 then format('{:012d}_night.jpg', p_partkey) else format('other_{:012d}_original.jpg', p_partkey) end"
_CLIP = "greatest(0, least(255, floor({})))::int"


def _unit(seed: str, key: str) -> str:
    return f"(('0x' || substr(md5('{seed}:' || {key}), 1, 13))::bigint / 4503599627370496::double)"


def _split(rows: str, by: str, unit: str) -> str:
    return f"select *, case when row_number() over (partition by {by} order by md5('42:' || {by} || ':' || {unit}), {unit}) <= floor(count(*) over (partition by {by}) * 0.2::double) then 'val' else 'train' end as split from ({rows})"


def oracle_sql() -> dict[str, str]:
    has = lambda name, words: f"case when {' or '.join(words)} then '{name}' end"
    anywhere = {n: [f"contains(p_name, '{w}')" for w in ws] for n, ws in (("tool", ("gear", "bolt", "widget")), ("hot", ("hot", "red")), ("ring", ("ring",)))}
    whole = {n: [f"regexp_matches(p_name, '\\b{w}\\b')" for w in ws] for n, ws in (("tool", ("gear", "bolt", "widget")), ("hot", ("hot", "red")), ("ring", ("ring",)))}
    joined = lambda tests: f"array_to_string(list_sort(list_filter([{', '.join(has(n, t) for n, t in tests.items())}], lambda x: x is not null)), ',')"
    grey = "(299 * max(v) filter (c = 0) + 587 * max(v) filter (c = 1) + 114 * max(v) filter (c = 2) + 500) // 1000"
    return {
        "r01_positive_curation": f"select o_orderkey as id, format('{{:012d}}', o_orderkey) as name from orders where o_orderkey in ({_PROMO}) order by o_orderkey limit 100",
        "r02_negative_strata": _SAMPLED,
        "r02b_overlap_of_strata": f"select 'all' as mode, stratum, count(*) as n from ({_STRATA}) group by stratum union all select 'exclusive', stratum, count(*) from (select image_id, max(stratum) as stratum from ({_STRATA}) group by image_id) group by stratum",
        "r02c_strict_join": f"select distinct image_id, o_totalprice from ({_SAMPLED}) join orders on image_id = o_orderkey",
        "r03_parse_existing": f"select distinct try_cast(split_part(name, '_', 1) as bigint) as image_id from (select {_PARTS} as name from part) where suffix(name, '_original.jpg') and try_cast(split_part(name, '_', 1) as bigint) is not null",
        "r04_nested_exists": """select u || '.jpg' as name, 'bdd_' || coalesce(w, '') || '_' || coalesce(t, '') || '_' || u || '.jpg' as copy_name from (
            select user_id as u, case user_id % 3 when 0 then 'rainy' when 1 then 'clear' end as w, case user_id % 4 when 0 then 'night' when 1 then 'daytime' end as t, bool_or(event_type = 'error') as e from events group by user_id)
            where e and (w = 'rainy' or t = 'night')""",
        "r05_stratified_split": _split("select vec_id, label::varchar as cls from embeddings", "cls", "vec_id"),
        "r05b_grouped_split": f"select p_partkey, cls, base, split from (select p_partkey, p_type as cls, p_partkey // 3 as base from part) join ({_split('select distinct p_type as cls, p_partkey // 3 as base from part', 'cls', 'base')}) using (cls, base)",
        "r06_variant_fanout": "select p_partkey as id, variant, format('other_{:012d}_', p_partkey) || variant || '.jpg' as name from part, (values ('original'), ('night'), ('rain')) v(variant)",
        "r06b_variant_draws": f"select p_partkey as id, variant, round(case variant when 'night' then 0.2::double + {_unit('night', 'p_partkey')} * (0.4::double - 0.2::double) else 0.5::double + {_unit('rain', 'p_partkey')} * (0.8::double - 0.5::double) end, 9) as factor from part, (values ('night'), ('rain')) v(variant)",
        "r07_grid_tiles": _TILES,
        "r08_tile_overlap_label": f"""with t as ({_TILES}), b as (select l_partkey as image_id, l_quantity % 20 as x_min, l_quantity % 30 as y_min, l_quantity % 20 + l_linenumber * 3 as x_max, l_quantity % 30 + l_linenumber * 5 as y_max from lineitem)
            select image_id, "index", (exists (select 1 from b where b.image_id = t.image_id and t.x_min < b.x_max and t.x_max > b.x_min and t.y_min < b.y_max and t.y_max > b.y_min))::int as label from t""",
        "r08b_tile_label_arrays": f'select image_id, "index", (x_min < 12 and x_max > 5 and y_min < 12 and y_max > 5)::int as label from ({_TILES})',
        "r09_coarse_keywords": f"select p_partkey, {joined(anywhere)} as categories, {joined(whole)} as whole_words from part",
        "r10_softmax_threshold": f"select vec_id, class_idx, round(p, 6) as p from ({_P}) where p >= 0.3::double",
        "r11_argmax": "select vec_id, (list_position(embedding, list_max(embedding)) - 1)::int as best, round(list_max(embedding)::double, 6) as score, list_position(embedding, list_max(embedding)) - 1 = label as hit from embeddings",
        "r12_confusion_metrics": """select lang, count(*) as n, count(*) filter (p and y) as tp, count(*) filter (p and not y) as fp, count(*) filter (not p and y) as fn, round(avg((p = y)::int::double), 9) as accuracy,
            round(case when count(*) filter (p) > 0 then count(*) filter (p and y) / count(*) filter (p) else 0 end::double, 9) as precision, round(case when count(*) filter (y) > 0 then count(*) filter (p and y) / count(*) filter (y) else 0 end::double, 9) as recall
            from (select lang, n_chars >= 500 as p, quality = 1 as y from labels join documents using (doc_id)) group by lang""",
        "r13_best_epoch": f"select epoch, val_acc from ({_EPOCHS}) where val_acc > 0 order by val_acc desc, epoch limit 1",
        "r13b_published_best": f"select 'published' as series, 7::bigint as epoch, 0.9749::double as val_acc union all select 'events', * from (select epoch, val_acc from ({_EPOCHS}) where val_acc > 0 order by val_acc desc, epoch limit 1)",
        "r14_natural_sort": "select p_brand, row_number() over (order by regexp_extract(p_brand, '^[^0-9]*'), regexp_extract(p_brand, '[0-9]+$')::int)::int as place from (select distinct p_brand from part)",
        "r14b_natural_order": "select o_orderkey, 'clerk ' || o_custkey % 97 || '/' || o_orderkey || '.jpg' as name, o_orderpriority, row_number() over (order by o_custkey % 97, o_orderkey) - 1 as place from orders",
        "r15_grid_pivot": "select l_orderkey % 50 as grid, (((l_linenumber - 1) % 9) // 3)::int as row, max(case when ((l_linenumber - 1) % 9) % 3 = 0 then l_returnflag end) as c0, max(case when ((l_linenumber - 1) % 9) % 3 = 1 then l_returnflag end) as c1, max(case when ((l_linenumber - 1) % 9) % 3 = 2 then l_returnflag end) as c2 from lineitem group by 1, 2",
        "r16_detections_collect": "select user_id as image, string_agg(event_type, ',' order by value / 100 desc, event_id) as labels from events where value / 100 >= 0.1::double group by user_id",
        "r17_gap_fill": "select i::int as tile, coalesce(n_name, 'missing') as mark, case when n_name is null then 'missing' else 'ok' end as status from range(9) t(i) left join nation on n_nationkey = i and n_nationkey % 3 <> 1",
        "r18_incremental": f"""select 'limit_first' as mode, o_orderkey as id from (select o_orderkey from orders where o_orderkey in ({_PROMO}) order by 1 limit 100) where o_orderkey % 2 <> 0
            union all (select 'new_only', o_orderkey from orders where o_orderkey in ({_PROMO}) and o_orderkey % 2 <> 0 order by 2 limit 100)""",
        "r18b_copies": "select p_partkey as pos, 'copy_' || p_partkey as copy_name from part where p_size > 10 and p_partkey % 5 <> 0 order by 1 limit 100",
        "r19_alias_lookup": "select doc_id, case lang when 'en' then 'english' when 'de' then 'german' else lower(lang) end as target from documents",
        "r20_target_score": f"select vec_id, round(sum(case when cat = 'bus' then p else 0::double end), 6) as score, sum(case when cat = 'bus' then p else 0::double end) >= 0.05::double as selected from ({_P}) p left join (select * from {_CATEGORIES} where cat = 'bus') c using (class_idx) group by vec_id",
        "r20b_best_categories": f"""with top as (select vec_id, class_idx from (select *, row_number() over (partition by vec_id order by p desc, class_idx) as n from ({_P})) where n <= 3)
            select vec_id, coalesce(string_agg(distinct cat, ',' order by cat), '') as categories from top left join {_CATEGORIES} c using (class_idx) group by vec_id""",
        "r21_losses": "select round(sum(loss * n) / sum(n), 6) as weighted_loss, round(avg(loss), 6) as mean_of_batches from (select avg(value) as loss, count(*) as n from events group by event_id // 32)",
        "r22_running_best": f"select epoch, val_acc, coalesce(max(val_acc) over w, 0::double) as best_before, val_acc > coalesce(max(val_acc) over w, 0::double) as improved from ({_EPOCHS}) window w as (order by epoch rows between unbounded preceding and 1 preceding)",
        "r23_pixel_ops": f"""with p as (select image, y, x, c, {_CLIP.format("v * 0.75::double")} as v from ({_PIXELS})),
            g as (select image, floor(avg(g) + 0.5::double) as m from (select image, y, x, {grey} as g from p group by all) group by image),
            q as (select p.image, y, x, c, {_CLIP.format("m + 0.5::double * (v - m)")} as v from p join g on p.image = g.image)
            select *, round((v / 255::double - ([0.485::double, 0.456::double, 0.406::double])[c + 1]) / ([0.229::double, 0.224::double, 0.225::double])[c + 1], 6) as n, (11 - x)::int as flipped_x, ((y // 3) * 3 + x // 4)::int as tile from q""",
        "r23b_pixel_nearest": f"""with p as ({_PIXELS}) select p.image, (k // 20)::int as y, (k % 20)::int as x, p.c, v from (select distinct image, c from p) s cross join range(100) t(k)
            join p on p.image = s.image and p.c = s.c where p.y = (k // 20) * 9 // 5 and p.x = (k % 20) * 12 // 20""",
        "r25_model_scoring": """select vec_id, (s < 0)::int as pred, round(100 / (1 + exp(-2 * abs(s))), 6) as percent
            from (select vec_id, list_sum(list_transform(range(64), lambda i: embedding[i + 1]::double * cos(i))) as s from embeddings)""",
        "r27_batches": "select batch, count(*) as n from (select (row_number() over (order by md5('epoch:' || vec_id), vec_id) - 1) // 32 as batch from embeddings) group by batch",
        "r26d_classified": """with s as (select vec_id, c, sum(e * cos((k - 1) * 10 + c) / 8) + sin(c) / 8 as s from (select vec_id, unnest(embedding)::double as e, unnest(range(1, 65)) as k from embeddings), range(10) t(c) group by vec_id, c)
            select vec_id, arg_max(c, s)::int as pred, round(1 / sum(exp(s - m)), 6) as p from (select *, max(s) over (partition by vec_id) as m from s) group by vec_id""",
        "r27b_epoch_batches": """select epoch, batch, count(*) as n, min(vec_id) as least, sum(vec_id)::bigint as ids from (
            select epoch::int as epoch, vec_id, (row_number() over (partition by epoch order by md5('epoch-' || epoch || ':' || vec_id), vec_id) - 1) // 32 as batch from embeddings, range(1, 4) t(epoch)) group by epoch, batch""",
        "r28_report": f"select epoch, printf('%-5s loss: %.4f acc: %.4f', 'Val', 1 - val_acc, val_acc) as line from ({_EPOCHS})",
    }
