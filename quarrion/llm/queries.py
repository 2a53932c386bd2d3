"""The registered queries of the training-data operators, each over its whole table, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from quarrion.llm.decontamination import contamination
from quarrion.llm.exact_dedup import exact_groups
from quarrion.llm.html_extraction import extract_pages
from quarrion.llm.language_id import language_spans
from quarrion.llm.lm_scoring import lm_scores
from quarrion.llm.mixing import mix
from quarrion.llm.near_dedup import near_groups
from quarrion.llm.quality import quality_scores
from quarrion.llm.secrets import scan_secrets
from quarrion.llm.shared import table
from quarrion.llm.spelling_variants import spelling_variants
from quarrion.llm.substring_dedup import drop_repeated_words
from quarrion.llm.suffix_dedup import drop_repeats
from quarrion.llm.target_resampling import importance_resample


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_spans(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"), size=4).drop("h")


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = drop_repeated_words(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = drop_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


def op13_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_suffix_dedup, op3_mixing, op4_language_id, op5_decontamination, op6_near_dedup, op7_lm_scoring, op8_substring_dedup, op9_html_extraction, op10_exact_dedup, op11_quality_classifier, op12_spelling_variants, op13_target_resampling, pipeline)}

#: Lower-cases A-Z only, in DuckDB.
LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: The kinds of op1 for RE2: name, pattern, group of the value, least length.
_KINDS = (
    ("assign", """((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]{24,}", 0, 24),
    ("owned", "[A-Za-z0-9+/_-]{24,}", 0, 24),
)


def _op1_kind(rank: int, kind: str, pattern: str, group: int, least: int) -> str:
    return f"""
        select rid, {rank} as rank, '{kind}' as kind, value, begin as start, begin + len(m) as stop from (
            select rid, m[i] as m, v[i] as value, list_sum(list_transform(g[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: len(x))), 0) as begin
            from (select rid, m, v, g, unnest(range(1, len(m) + 1)) as i from (
                select rid, regexp_extract_all(text, '{pattern}') as m, regexp_extract_all(text, '{pattern}', {group}) as v, string_split_regex(text, '{pattern}') as g from d)))
        where len(value) >= {least}"""


#: Checksums in SQL. A checksum is linear: it is the exclusive or of what each byte gives by its distance from the end, and
#: of what the start gives by the length. Expects byte strings as hexadecimal digits in texts(s); gives crcs(s, crc).
_CRC = """
        bits(b, k, v) as (select b, 0, b::bigint from range(256) t(b) union all select b, k + 1, xor(v >> 1, 3988292384 * (v & 1)) from bits where k < 8),
        lookup as (select b, v from bits where k = 8),
        far(b, k, v) as (
            select b, 0, v from lookup union all select -1, 0, 4294967295
            union all select f.b, k + 1, xor(f.v >> 8, l.v) from far f join lookup l on l.b = f.v & 255 where k < (select max(length(s)) // 2 from texts)),
        single as (select s, i, ('0x' || substr(s, 2 * i - 1, 2))::int as b from (select s, unnest(range(1, length(s) // 2 + 1)) as i from texts)),
        crcs as (
            select s, xor(xor(bit_xor(f.v), any_value(e.v)), 4294967295) as crc
            from single join far f on f.b = single.b and f.k = length(s) // 2 - i join far e on e.b = -1 and e.k = length(s) // 2 group by s)"""

ORACLE = {
    "op12_spelling_variants": f"""
        with recursive run as (
            select coalesce(doc_id::varchar, '') as id, unnest(regexp_extract_all({LOW.format("coalesce(text, '')")}, '[A-Za-z\\x{{C0}}-\\x{{FF}}]{{7,}}')) as r from documents),
        seen as (select hex(encode(id || ':' || r)) as s, any_value(r) as r, count(*) as c from run group by all),
        texts as (select s from seen),{_CRC},
        word as (
            select case when crc % 31 = 0 then substr(r, 1, (crc % length(r))::int) || substr(r, (crc % length(r))::int + 2) else r end as word, sum(c)::bigint as n
            from seen join crcs using (s) group by 1 having length(word) >= 7 and sum(c) >= 2),
        less as (select word, n, length(word) as size, p, substr(word, 1, p - 1) || substr(word, p + 1) as rest from (select word, n, unnest(range(1, length(word) + 1)) as p from word)),
        near as (
            select a.word, b.word as other, b.n from less a join less b on a.size = b.size and a.p = b.p and a.rest = b.rest and a.word <> b.word
            union select a.word, b.word, b.n from less a join word b on a.rest = b.word
            union select b.word, a.word, a.n from less a join word b on a.rest = b.word),
        best as (select word, count(*) as n_near, first(other order by n desc, other) as other, max(n) as most from near group by word),
        formed as (
            select w.word, w.n, coalesce(n_near, 0) as n_near, case when most >= 10 * w.n then other end as form, case when most >= 10 * w.n then most end as form_n
            from word w left join best using (word)),
        walk(word, root) as (select word, word from formed union select walk.word, f.form from walk join formed f on f.word = walk.root where f.form is not null)
        select f.word, f.form, walk.root, f.n, f.n_near, f.form_n
        from formed f join walk using (word) join formed e on e.word = walk.root where e.form is null""",
    "op13_target_resampling": f"""
        with recursive d as (select row_number() over () as rid, doc_id, regexp_extract_all({LOW.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents),
        b as (select -row_number() over () as rid, regexp_extract_all({LOW.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from benchmark),
        feats as (
            select rid, hex(encode(array_to_string(w[i:i + n - 1], ' '))) as s, count(*) as c
            from (select rid, w, n, unnest(range(1, len(w) - n + 2)) as i from (select rid, w from d union all select rid, w from b), (values (1), (2), (3)) t(n))
            group by all),
        texts as (select distinct s from feats),{_CRC},
        placed as (select rid, crc % 10000 as bucket, sum(c)::bigint as c from feats join crcs using (s) group by all),
        counts as (select k as bucket, coalesce(sum(c) filter (where rid > 0), 0)::double as s, coalesce(sum(c) filter (where rid < 0), 0)::double as t from range(10000) r(k) left join placed on k = bucket group by k),
        gains as (select bucket, floor(1000 * ln((t + 1) * (sum(s) over () + 10000) / ((s + 1) * (sum(t) over () + 10000))))::bigint as gain from counts),
        per as (select rid, sum(c)::bigint as n_features, sum(c * gain)::bigint as weight from placed join gains using (bucket) where rid > 0 group by rid),
        scored as (
            select rid, doc_id, len(w) >= 20 as eligible, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
                   coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint + 0.5::double) / 4294967296)))::bigint as score
            from d left join per using (rid)),
        placed_docs as (select *, row_number() over (order by eligible desc, score desc, doc_id nulls last) as place, count(*) filter (where eligible) over () * 5 // 100 as drawn from scored)
        select doc_id, n_features, weight, score, case when eligible and place <= drawn then place end as rank from placed_docs""",
    "op1_secret_scan": f"""
        with d as (select row_number() over () as rid, doc_id, source, coalesce(text, '') as text from documents),
        found as ({" union all ".join(_op1_kind(i, *k) for i, k in enumerate(_KINDS))}),
        mixed as (select rid from d where len(list_filter(regexp_extract_all(text, '[A-Za-z0-9+/_-]{{24,}}'), lambda x: regexp_matches(x, '[0-9]') and regexp_matches(x, '[A-Za-z]'))) > 0),
        cand as (
            select f.* from found f where kind <> 'owned' or (rid in (select rid from mixed) and not exists (
                select 1 from found b where b.rid = f.rid and b.kind <> 'owned' and b.start < f.stop and f.start < b.stop))),
        owners as (select value, count(distinct coalesce(source, chr(0))) as n, count(distinct struct_pack(s := coalesce(source, chr(0)), d := coalesce(doc_id::varchar, chr(0)))) as r from cand join d using (rid) group by value),
        judged as (select c.*, n <= 1 and r <= 20 as live from cand c join owners using (value)),
        per as (
            select rid, count(*) filter (where kind = 'assign') as n_assign, count(*) filter (where kind = 'access') as n_access, count(*) filter (where kind = 'hex') as n_hex,
                   string_agg(concat_ws(':', kind, start, stop), ',' order by start, rank, stop) filter (where kind <> 'owned') as base,
                   string_agg(concat_ws(':', kind, start, stop), ',' order by start, rank, stop) filter (where kind <> 'owned' or live) as spans,
                   count(*) filter (where live) as n_live, count(*) filter (where not live) as n_example
            from judged group by rid)
        select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256,
               coalesce(spans, '') as spans, coalesce(n_live, 0) as n_live, coalesce(n_example, 0) as n_example
        from d left join per using (rid)""",
    "op3_mixing": """
        with sized as (
            select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) as size,
                   md5(concat_ws('|', 'mix', doc_id::varchar, md5(coalesce(text, '')))) as key
            from documents),
        per as (
            select source, sum(size)::bigint as source_size, 3 * sum(size)::bigint as cap,
                   (row_number() over (order by source nulls last) - 1) % 3 + 1 as weight
            from sized group by source),
        lev as (
            select *, (sum(source_size) over () - coalesce(sum(cap) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0))::double
                      / (sum(weight) over (order by cap / weight, source nulls last rows between current row and unbounded following))::double as level
            from per),
        tgt as (
            select source, source_size,
                   case when level * weight > cap then cap::double
                        else (first_value(level) over (order by level * weight > cap, cap / weight, source nulls last)) * weight end as target
            from lev),
        served as (
            select doc_id, source, size, sum(size) over w as served, row_number() over w as rank from sized
            window w as (partition by source order by key, doc_id, size rows unbounded preceding)),
        copies as (
            select s.*, t.source_size, t.target, c.copy, (c.copy * t.source_size + s.served)::double / t.target as finish
            from served s join tgt t on s.source is not distinct from t.source, (values (0), (1), (2)) c(copy) where size > 0),
        queue as (
            select *, sum(size) over (order by finish, source nulls last, rank, copy rows unbounded preceding) as done, (select sum(size) from sized) as budget
            from copies),
        n as (select source, rank, count(*) as n from queue where 2 * done - size <= 2 * budget group by all)
        select s.doc_id, s.size, t.source_size, t.target, (s.size * coalesce(n.n, 0))::bigint as taken
        from served s join tgt t on s.source is not distinct from t.source
        left join n on s.source is not distinct from n.source and s.rank = n.rank""",
    "op5_decontamination": f"""
        with d as (select doc_id, regexp_extract_all({LOW.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents),
        i as (select item_id::varchar as item, regexp_extract_all({LOW.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from benchmark),
        win as (select item, least(10, len(w)) as n, array_to_string(w[k:k + 9], ' ') as s
                from (select item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) as k from i where len(w) > 0)),
        sizes as (select distinct n from win),
        places as (select doc_id, w, unnest(range(1, len(w) + 1)) as p from d),
        occ as (select p.doc_id, p.p, s.n, win.item from places p, sizes s, win
                where p.p + s.n - 1 <= len(p.w) and win.n = s.n and win.s = array_to_string(p.w[p.p:p.p + s.n - 1], ' ')),
        hit as (select doc_id, count(distinct q) as n_hit from (select doc_id, unnest(range(p, p + n)) as q from occ) group by doc_id),
        its as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item from occ) group by doc_id)
        select d.doc_id, len(d.w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
        from d left join hit using (doc_id) left join its using (doc_id)""",
    "op6_near_dedup": f"""
        with recursive d as (select doc_id, regexp_extract_all({LOW.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') as w from documents),
        sh as (select distinct doc_id, hash(array_to_string(w[k:k + 3], ' ')) as s from (select doc_id, w, unnest(range(1, greatest(1, len(w) - 3) + 1)) as k from d where len(w) > 0)),
        n as (select doc_id, count(*) as n from sh group by doc_id),
        pair as (select a.doc_id as a, b.doc_id as b, count(*) as c from sh a join sh b on a.s = b.s and a.doc_id < b.doc_id group by all),
        link as (select a, b from pair join n x on a = x.doc_id join n y on b = y.doc_id where 100 * c >= 80 * (x.n + y.n - c)),
        edge as (select a, b from link union all select b, a from link),
        reach as (select doc_id, doc_id as c from d union select r.doc_id, e.b from reach r join edge e on r.c = e.a),
        comp as (select doc_id, min(c) as component_id from reach group by doc_id)
        select d.doc_id, coalesce(n.n, 0) as n_shingles, component_id, d.doc_id = component_id as kept
        from d left join n using (doc_id) join comp using (doc_id)""",
    "op8_substring_dedup": """
        with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
        win as (select doc_id, p, md5(array_to_string(w[p:p + 34], ' ')) as s from (select doc_id, w, unnest(range(1, len(w) - 33)) as p from d where len(w) >= 35)),
        again as (select doc_id, p from win where s in (select s from win group by s having count(*) > 1)),
        gone as (select doc_id, list(distinct q) as g from (select doc_id, unnest(range(p, p + 35)) as q from again) group by doc_id),
        kept as (select d.doc_id, len(w) as n_words, coalesce(len(g), 0) as n_removed,
                        array_to_string(list_transform(list_filter(range(1, len(w) + 1), lambda q: g is null or not list_contains(g, q)), lambda q: w[q]), ' ') as k
                 from d left join gone using (doc_id))
        select doc_id, n_words, n_removed, sha256(k) as kept_sha256 from kept""",
    "op10_exact_dedup": f"""
        with n as (select doc_id, {LOW.format("coalesce(text, '')")} as norm from documents)
        select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
               doc_id = max(doc_id) over w as kept, sha256(norm) as text_sha256
        from n window w as (partition by norm)""",
}
