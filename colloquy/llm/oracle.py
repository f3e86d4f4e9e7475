"""DuckDB SQL for the rows of those queries that SQL can express."""

from .quality import COMMON, MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE, MIN_CHARS, MIN_REFERENCE_WORDS, MIN_WORDS

W = r"[^\x20\x09-\x0D]+"


def _count(chars: str) -> str:
    return f"length(regexp_replace(text, '[^{chars}]', '', 'g'))"


_CLASSES = [_count("a-z"), _count("A-Z"), _count("0-9"), _count(r"\x20\x09-\x0D"), _count(r".,;:!?''\"()\-"), r"length(regexp_replace(text, '[\x00-\x7F]', '', 'g'))"]

QUALITY = rf"""with d as (select row_number() over () rid, doc_id, text, lang from documents),
 ws as (select *, regexp_extract_all(coalesce(text, ''), '{W}') w from d),
 words as (select rid, lang, unnest(w) word, generate_subscripts(w, 1) i from ws),
 three as (select rid, i, word, lead(word, 1) over (partition by rid order by i) b, lead(word, 2) over (partition by rid order by i) c from words),
 twice as (select rid, i, c is not null and count(*) over (partition by rid, word, b, c) > 1 f from three),
 covered as (select rid, f or coalesce(lag(f, 1) over (partition by rid order by i), false) or coalesce(lag(f, 2) over (partition by rid order by i), false) g from twice),
 repeats as (select rid, count(*) filter (g) n from covered group by 1),
 lines as (select rid, unnest(string_split(text, chr(10))) line from d where text is not null),
 dups as (select rid, count(*) - count(distinct line) n from lines where regexp_matches(line, '{W}') group by 1),
 base as (select ws.*, len(w) n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) word_chars, coalesce({_count("#*$%&|<>")}, 0) n_symbols, coalesce(dups.n, 0) n_dup_lines, coalesce(repeats.n, 0) n_repeat_words from ws left join dups using (rid) left join repeats using (rid)),
 failed as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words base_failed from base),
 k0 as (select rid, lang, length(text) total, {", ".join(f"{c} c{i}" for i, c in enumerate(_CLASSES))} from d where text is not null),
 k as (select rid, lang, unnest([c0, c1, c2, c3, c4, c5, total - c0 - c1 - c2 - c3 - c4 - c5]) n, unnest(range(7)) k from k0),
 totals as (select lang, count(*) s from words group by all),
 langs as (select distinct lang from d),
 groups as (select lang, coalesce('L' || lang, 'none') g from langs union all select lang, 'all' from langs),
 ref as (select langs.lang, case when coalesce(s, 0) >= {MIN_REFERENCE_WORDS} then coalesce('L' || langs.lang, 'none') else 'all' end g from langs left join totals on langs.lang is not distinct from totals.lang),
 sizes as (select g, sum(s) s from groups join totals on groups.lang is not distinct from totals.lang group by 1),
 kref as (select g, k, sum(n) n from k join groups on k.lang is not distinct from groups.lang group by all), ksum as (select g, sum(n) s from kref group by all),
 kp as (select k.rid, k.n / nullif(sum(k.n) over (partition by k.rid), 0) p, kref.n / ksum.s q, sum(k.n) over (partition by k.rid) total from k join ref on k.lang is not distinct from ref.lang join kref on k.k = kref.k and ref.g = kref.g join ksum on ref.g = ksum.g),
 kd as (select rid, any_value(total) chars, sqrt(greatest(0, (sum(case when p > 0 then p * log2(p / ((p + q) / 2)) else 0 end) + sum(case when q > 0 then q * log2(q / ((p + q) / 2)) else 0 end)) / 2)) js from kp group by 1),
 common as (select w.g, word, sum(n) n, any_value(s) s from (select g, word, count(*) n from words join groups on words.lang is not distinct from groups.lang group by all) w join sizes on w.g = sizes.g group by w.g, word having {COMMON} * sum(n) >= any_value(s)),
 bins as (select f.rid, c.word, c.n / c.s q, f.n_words from failed f join ref on f.lang is not distinct from ref.lang join common c on ref.g = c.g where f.n_words > 0),
 own as (select rid, word, count(*) n from words group by all),
 filled as (select b.rid, b.q, coalesce(o.n, 0) / b.n_words p from bins b left join own o on b.rid = o.rid and b.word = o.word),
 wp as (select rid, p, q from filled union all select rid, 1 - sum(p), 1 - sum(q) from filled group by 1),
 wd as (select rid, sqrt(greatest(0, (sum(case when p > 1e-12 then p * log2(p / ((p + q) / 2)) else 0 end) + sum(case when q > 1e-12 then q * log2(q / ((p + q) / 2)) else 0 end)) / 2)) js from wp group by 1)
 select doc_id, n_words, cast(word_chars as bigint) word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and (coalesce(t.s, 0) < {MIN_REFERENCE_WORDS} or (not (coalesce(chars, 0) >= {MIN_CHARS} and coalesce(kd.js, 0) > {MAX_CHAR_DISTANCE}) and not (n_words >= {MIN_WORDS} and coalesce(wd.js, 0) > {MAX_WORD_DISTANCE}))) kept
 from failed f left join kd using (rid) left join wd using (rid) join ref on f.lang is not distinct from ref.lang left join sizes t on ref.g = t.g"""

SUBSTRING = rf"""with d as (select row_number() over () rid, doc_id, regexp_extract_all(coalesce(text, ''), '{W}') w from documents),
 words as (select rid, unnest(w) word, generate_subscripts(w, 1) i from d),
 starts as (select rid, unnest(range(1, len(w) - 33)) i from d where len(w) >= 35),
 named as (select s.rid, s.i, md5(array_to_string(d.w[s.i:s.i + 34], ' ')) h from starts s join d using (rid)),
 twice as (select rid, i from named qualify count(*) over (partition by h) > 1),
 flagged as (select words.rid, words.i, word, twice.i is not null f from words left join twice on words.rid = twice.rid and words.i = twice.i),
 covered as (select rid, i, word, bool_or(f) over (partition by rid order by i rows between 34 preceding and current row) g from flagged),
 kept as (select rid, count(*) filter (g) n, string_agg(word, ' ' order by i) filter (not g) k from covered group by 1)
 select doc_id, len(w) n_words, coalesce(n, 0) n_removed, sha256(coalesce(k, '')) kept_sha256 from d left join kept using (rid)"""

SUFFIX = """with d as (select row_number() over () rid, doc_id, hex(encode(coalesce(text, ''))) x from documents),
 n as (select *, cast(length(x) // 2 as bigint) n_bytes from d),
 starts as (select rid, unnest(range(0, n_bytes - 399)) i from n where n_bytes >= 400),
 named as (select rid, i, md5_number(substr(x, 2 * i + 1, 800)) h from starts join n using (rid)),
 twice as (select rid, i from named qualify count(*) over (partition by h) > 1),
 marked as (select *, i > coalesce(lag(i) over (partition by rid order by i), -401) + 400 opens from twice),
 runs as (select *, sum(opens::int) over (partition by rid order by i) run from marked),
 spans as (select rid, run, min(i) a, max(i) + 400 b from runs group by all),
 gaps as (select rid, a, b, coalesce(lag(b) over (partition by rid order by a), 0) before from spans),
 ends as (select rid, max(b) b from spans group by 1),
 kept as (select rid, before a, a b from gaps union all select rid, coalesce(b, 0), n_bytes from n left join ends using (rid)),
 joined as (select rid, string_agg(substr(x, 2 * a + 1, 2 * (kept.b - a)), '' order by a) k from kept join n using (rid) group by 1),
 counts as (select rid, cast(sum(b - a) as bigint) n_removed, count(*) n_spans from spans group by 1)
 select doc_id, n_bytes, coalesce(n_removed, 0) n_removed, coalesce(n_spans, 0) n_spans, sha256(unhex(k)) kept_sha256 from n join joined using (rid) left join counts using (rid)"""

JACCARD = rf"""with recursive d as (select row_number() over () rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{W}') w from documents),
 starts as (select rid, unnest(range(1, len(w) - 3)) i from d where len(w) >= 5),
 grams as (select distinct rid, md5(array_to_string(w[i:i + 4], ' ')) g from starts join d using (rid) union all select rid, md5('short ' || array_to_string(w, ' ')) from d where len(w) between 1 and 4),
 sizes as (select rid, count(*) n from grams group by 1),
 shared as (select a.rid a, b.rid b, count(*) o from grams a join grams b on a.g = b.g and a.rid <> b.rid group by all),
 links as (select a, b from shared join sizes x on x.rid = a join sizes y on y.rid = b where 100 * o >= 75 * (x.n + y.n - o)),
 reach as (select rid a, rid b from d union select r.a, l.b from reach r join links l on r.b = l.a)
 select d.doc_id, coalesce(n, 0) n_shingles, component_id from d left join sizes using (rid) join (select a, min(o.doc_id) component_id from reach join d o on o.rid = b group by 1) c on c.a = d.rid"""

WARC = """with p as (select page_id, strlen(coalesce(html, '')) payload_bytes, sha1(coalesce(html, '')) h from pages),
 v as (select *, list_transform(range(8), lambda g: cast('0x' || substr(h, cast(5 * g + 1 as bigint), 5) as int)) n, max(page_id) over (partition by h) w from p)
 select page_id, payload_bytes, array_to_string(list_transform(n, lambda x: array_to_string(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x >> s) & 31) + 1, 1)), '')), '') payload_digest, case when page_id = w then 'response' else 'revisit' end record_type, case when page_id <> w then w end refers_to from v"""

_LATIN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_CRC = "c"
for _ in range(8):
    _CRC = f"list_transform([{_CRC}], lambda v: case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end)[1]"

IMPORTANCE = rf"""with d as (select row_number() over () rid, doc_id, regexp_extract_all({_LOWER}, '{_LATIN}') w from documents),
 b as (select unnest(regexp_extract_all({_LOWER}, '{_LATIN}')) word from benchmark),
 own as (select rid, word, count(*) n from (select rid, unnest(w) word from d) group by all),
 vocabulary as (select distinct word from own union select distinct word from b),
 bytes as (select word, list_transform(range(0, cast(strlen(word) as bigint)), lambda i: cast(cast('0x' || substr(hex(encode(word)), cast(2 * i + 1 as bigint), 2) as int) as bigint)) x from vocabulary),
 named as (select word, xor(list_reduce(x, lambda c0, v: list_transform([xor(c0, v)], lambda c: {_CRC})[1], 4294967295::bigint), 4294967295) % 10000 bucket from bytes),
 source as (select bucket, sum(n) s from own join named using (word) group by 1),
 target as (select bucket, count(*) t from b join named using (word) group by 1),
 totals as (select coalesce((select sum(s) from source), 0) ss, coalesce((select sum(t) from target), 0) tt),
 gains as (select bucket, cast(floor(1000 * ln((coalesce(t, 0) + 1.0::double) * (ss + 10000.0::double) / ((s + 1.0::double) * (tt + 10000.0::double)))) as bigint) gain from source left join target using (bucket), totals),
 weights as (select rid, sum(n * gain) weight from own join named using (word) join gains using (bucket) group by 1),
 scored as (select d.rid, doc_id, len(w) n_features, cast(coalesce(weight, 0) as bigint) weight, cast(coalesce(weight, 0) + floor(-1000 * ln(-ln((cast('0x' || substr(sha256('2024:' || coalesce(cast(doc_id as varchar), '')), 1, 8) as bigint) + 0.5::double) / 4294967296.0::double))) as bigint) score from d left join weights using (rid)),
 ordered as (select rid, row_number() over (order by score desc, doc_id nulls last) r from scored where n_features >= 20)
 select doc_id, n_features, weight, score, case when r <= (select floor(10 * count(*) / 100) from ordered) then r end rank from scored left join ordered using (rid)"""


def _compression() -> str:
    """Codebooks after four rounds, one table after the other."""
    steps = [
        "kept as (select row_number() over () rid, vec_id, label, list_transform(embedding, lambda x: cast(floor(1024 * x::double) as bigint)) v from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)",
        "parts as materialized (select rid, p, v[p * len(v) // 4 + 1:(p + 1) * len(v) // 4] v from kept, (select unnest(range(4)) p))",
        "c0 as materialized (select p, row_number() over (partition by p order by vec_id) - 1 entry, parts.v from parts join (select rid, vec_id from kept order by vec_id limit 256) using (rid))",
    ]
    for i in range(5):
        distance = "list_sum(list_transform(list_zip(parts.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
        steps.append(f"a{i} as materialized (select rid, p, arg_min(entry, d * 256 + entry) entry, cast(min(d) as bigint) d from (select rid, parts.p, entry, {distance} d from parts join c{i} c on parts.p = c.p) group by all)")
        if i < 4:
            steps.append(f"m{i} as (select p, entry, k, cast(floor(sum(x) / count(*)) as bigint) x from (select p, entry, unnest(v) x, generate_subscripts(v, 1) k from parts join a{i} using (rid, p)) group by all)")
            steps.append(f"c{i + 1} as materialized (select p, entry, coalesce(n.v, c.v) v from c{i} c left join (select p, entry, list(x order by k) v from m{i} group by all) n using (p, entry))")
    steps.append("coded as (select rid, string_agg(printf('%02x', cast(entry as int)), '' order by p) code, cast(sum(d) as bigint) error from a4 group by 1)")
    steps.append("digest as (select sha256(coalesce(string_agg(array_to_string(v, ','), ',' order by p, entry), '')) codebooks_sha256 from c4)")
    return f"with {', '.join(steps)} select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) label_error, codebooks_sha256 from kept join coded using (rid), digest"


COMPRESSION = _compression()

ORACLE_SQL = {
    "op2_quality_rules": QUALITY,
    "op7_substring_dedup": SUBSTRING,
    "op8_jaccard_join": JACCARD,
    "op9_warc": WARC,
    "op10_suffix_array_dedup": SUFFIX,
    "op11_importance_resampling": IMPORTANCE,
    "op13_vector_compression": COMPRESSION,
}
