"""The same semantics in SQL of another engine, from which the catalog's checks are put together."""

from __future__ import annotations

from ..functions import lexicon as L

PART = """select concat('S', cast(1 + p_partkey % 3 as varchar), '-', lpad(cast(p_partkey as varchar), 7, '0')) as entity_id, p_name as business_name,
  concat(cast(p_size as varchar), ' ', p_type, ' Road, ', cast(10000 + p_partkey % 50 as varchar)) as business_address,
  case p_size % 3 when 0 then 'US' when 1 then 'India' else 'France' end as country from part"""
DOC = """select concat('S', cast(1 + doc_id % 3 as varchar), '-', lpad(cast(doc_id as varchar), 7, '0')) as entity_id,
  substr(split_part(split_part(text, chr(10), 1), '.', 1), 1, 60) as business_name,
  case when doc_id % 29 = 0 then null else concat(cast(n_chars % 1000 as varchar), ' ', source, ' Street, ', cast(10000 + n_chars % 500 as varchar)) end as business_address,
  lang as country from documents"""
SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def listed(words) -> str:
    return ", ".join(map(quoted, words))


def a_map(m: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"{quoted(k)}: {quoted(v)}" for k, v in m.items()) + "}"


def base(x: str) -> str:
    return f"replace(lower(strip_accents(replace(replace(replace(replace(replace(coalesce({x}, ''), 'ß', 'ss'), 'æ', 'ae'), 'Æ', 'AE'), 'œ', 'oe'), 'Œ', 'OE'))), '&', ' and ')"


def group(x: str, pattern: str) -> str:
    return f"nullif(regexp_extract({x}, {quoted(pattern)}, 1), '')"


def toks(x: str) -> str:
    return f"[t for t in regexp_split_to_array({x}, '\\s+') if t <> '']"


def no_punct(x: str) -> str:
    return no_punct_all(x)


def mapped(x: str, m: dict[str, str]) -> str:
    return f"[coalesce(({a_map(m)})[t], t) for t in {x}]"


def name_tokens(cleaned: str) -> str:
    return mapped(toks(no_punct(f"regexp_replace({cleaned}, {quoted(L.NAME_DOMAIN)}, ' ', 'g')")), L.LEGAL_MAP)


def without(x: str, stop: list[str], least: int = 0) -> str:
    return f"[t for t in {x} if t not in ({listed(stop)}) and length(t) >= {least}]"


def initials(x: str) -> str:
    return f"array_to_string([substr(t, 1, 1) for t in {x}], '')"


def grams(x: str) -> str:
    return f"case when {x} = '' then [] else list_distinct([substr({x}, i, 3) for i in range(1, greatest(length({x}) - 2, 1) + 1)]) end"


def country(x: str) -> str:
    cases = " ".join(f"when upper(trim(coalesce({x}, ''))) in ({listed(v)}) then {quoted(k)}" for k, v in L.COUNTRY_SPELLINGS.items())
    return f"case {cases} else upper(trim(coalesce({x}, ''))) end"


def strip_domain(x: str) -> str:
    out = f"trim(lower(coalesce({x}, '')), {SPACE})"
    for p in (L.LEADING_NOISE, L.DOMAIN_PREFIX, L.DOMAIN_SUFFIX, L.DOMAIN_UNSPACED):
        out = f"regexp_replace({out}, {quoted(p)}, '', 'g')"
    return out


def jaccard(a: str, b: str) -> str:
    both = f"len(list_intersect({a}, {b}))"
    return f"case when len({a}) + len({b}) = 0 then 1.0 else {both} / (len({a}) + len({b}) - {both})::double end"


def containment(a: str, b: str) -> str:
    return f"case when least(len({a}), len({b})) = 0 then 0.0 else len(list_intersect({a}, {b})) / least(len({a}), len({b}))::double end"


def rep(view: str) -> str:
    """CTEs rec, norm, rep: the representation of a view's records."""
    return f"""rec as ({view}),
norm as (select entity_id, {country('country')} as country, {base('business_name')} as n, {base('business_address')} as a from rec),
words as (select entity_id, country, {name_tokens('n')} as name_tokens, {mapped(toks(no_punct('a')), L.ADDRESS_MAP)} as addr_tokens,
  translate({group('a', L.POSTAL)}, '- ', '') as postal, {group('a', L.STREET_NUMBER)} as street_no, trim({group('a', L.LANDMARK)}) as landmark from norm),
joined as (select *, array_to_string(name_tokens, ' ') as name_clean, array_to_string(name_tokens, '') as compressed, array_to_string(addr_tokens, ' ') as addr_clean, array_to_string(addr_tokens, '') as addr_joined,
  {initials('name_tokens')} as acronym_all, {initials(without('name_tokens', L.ACRONYM_STOP))} as acronym_core from words),
rep as (select *, list_distinct(name_tokens) as name_set, case when acronym_core <> '' then acronym_core else acronym_all end as acronym, substr(name_clean, 1, 4) as prefix4,
  array_to_string(list_sort(name_tokens), ' ') as name_sorted, {grams('compressed')} as name_char3, list_distinct(addr_tokens) as addr_set, {grams('addr_joined')} as addr_char3 from joined)"""


def parts(view: str, sounds: bool = False, rules: str = "") -> str:
    """CTEs rec, p0, p1, parts: what blocking keys are made of. ``rules``: a table (country, variant, canonical) to map tokens by."""
    digits = "not regexp_matches(t, '^\\d+$')"
    printed = f"list_slice([t for t in {without(toks(no_punct_all('lower(raw)')), L.ADDRESS_STOP, 3)} if {digits}], 1, 4)"
    by_rule = lambda x: f"list_transform({x}, lambda t: coalesce(m[t], t))"
    rows = "(select * replace ({} as toks), {} as print_addr from p2 {})".format(*((by_rule("toks"), by_rule("printed"), f"left join (select country, map(list(variant), list(canonical)) as m from {rules} group by 1) using (country)") if rules else ("toks", "printed", "")))
    return f"""rec as ({view}),
p0 as (select entity_id, {country('country')} as country, coalesce(business_address, '') as raw, {name_tokens(base(strip_domain('business_name')))} as toks, {base('business_address')} as a from rec),
p1 as (select entity_id, country, raw, toks, {mapped(toks(no_punct('a')), L.ADDRESS_MAP)} as addr_tokens, translate({group('a', L.POSTAL)}, '- ', '') as postal, {group('a', L.STREET_NUMBER)} as street_no, {group('raw', L.PLOT)} as plot from p0),
p2 as (select *, array_to_string(toks, ' ') as clean, array_to_string(toks, '') as comp, {printed} as printed from p1),
{'parts0' if sounds else 'parts'} as (select *, {without('toks', L.LEGAL + L.CORE_STOP_V1, 2)} as core, {without('toks', L.LEGAL + L.NAME_STOP + L.CORE_STOP_V2, 2)} as core2,
  {without('toks', L.LEGAL + L.NAME_STOP, 4)} as rare_name, {without('toks', L.LEGAL + L.NAME_STOP, 3)} as rare_name2,
  [t for t in {without('addr_tokens', L.ADDRESS_STOP, 4)} if {digits}] as rare_addr from {rows})""" + (f""",
heard as (select *, list_transform(list_filter(core2, lambda t: length(t) >= 3), lambda t: {soundex('t')}) as heard from parts0),
parts as (select *, list_slice(list_filter(heard, lambda v, i: list_position(heard, v) = i), 1, 3) as sounds from heard)""" if sounds else "")


def no_punct_all(x: str) -> str:
    """Letters of any script are kept."""
    return f"regexp_replace({x}, '[^\\p{{L}}\\p{{M}}\\p{{N}}_\\s]', ' ', 'g')"


def _keys(rows: list[tuple[str, str, list[str], float, str]], lists: list[tuple[str, str, float, str]], name: str) -> str:
    selects, n = [], 0
    for kind, condition, fields, weight, cap in rows:
        selects.append(f"select entity_id, country, {n} as ord1, 0 as ord2, '{kind}' as kind, concat_ws('_', '{kind}', country, {', '.join(fields)}) as key, {weight}::double as weight, '{cap}' as cap_class from parts where {condition}")
        n += 1
    for kind, words, weight, cap in lists:
        selects.append(f"select entity_id, country, {n} as ord1, i as ord2, '{kind}' as kind, concat_ws('_', '{kind}', country, {words}[i]) as key, {weight}::double as weight, '{cap}' as cap_class from (select *, unnest(range(1, len({words}) + 1)) as i from parts)")
        n += 1
    return f"{name}0 as ({' union all '.join(selects)}),\n{name} as (select *, row_number() over (partition by entity_id order by ord1, ord2) - 1 as key_ord from {name}0)"


def keys_v1() -> str:
    core, t0, r0 = "array_to_string(core, '')", "toks[1]", "addr_tokens[1]"
    stop = listed(L.NAME_STOP + L.LEGAL)
    rows = [
        ("nm", "clean <> ''", ["clean"], 3, "key"), ("cp", "length(comp) >= 3", ["comp"], 3, "key"),
        ("cr", f"length({core}) >= 3", [core], 3, "key"), ("sc", f"length({core}) >= 3", ["array_to_string(list_sort(core), '')"], 3, "key"),
        ("f2", "len(toks) >= 2", [t0, "toks[2]"], 2, "key"), ("f1", f"length({t0}) >= 3 and {t0} not in ({stop})", [t0], 2, "key"),
        ("pin", f"postal is not null and length({t0}) >= 2", ["postal", f"substr({t0}, 1, 3)"], 2, "key"),
        ("st_addr", "street_no is not null and rare_addr[1] is not null", ["street_no", "rare_addr[1]"], 2, "key"),
        ("st_addr", "street_no is not null and rare_addr[2] is not null", ["street_no", "rare_addr[2]"], 2, "key"),
        ("st_rd", f"street_no is not null and length({r0}) >= 3 and {r0} <> street_no and {r0} not in ({listed(L.ADDRESS_STOP)})", ["street_no", f"substr({r0}, 1, 4)"], 2, "key"),
        ("st_nm", "street_no is not null and length(comp) >= 3", ["street_no", "substr(comp, 1, 3)"], 2, "key"),
        ("plt", "plot is not null and rare_addr[1] is not null", ["plot", "rare_addr[1]"], 2, "key"),
    ]
    return _keys(rows, [("tok", "rare_name", 1, "key")], "keys")


def keys_v2(sounds: bool = False) -> str:
    core, first, a1, a2 = "array_to_string(core2, '')", "core2[1]", "print_addr[1]", "print_addr[2]"
    rows = [
        ("nm", "clean <> ''", ["clean"], 4, "exact"), ("cp", "length(comp) >= 3", ["comp"], 4, "exact"), ("cr", f"length({core}) >= 3", [core], 4, "exact"),
        ("sc", f"length({core}) >= 3", ["array_to_string(list_sort(core2), '')"], 4, "exact"),
        ("cmp", f"{first} is not null and postal is not null", [first, "'p' || postal"], 3, "key"),
        ("cmp", f"{first} is not null and {a1} is not null", [first, f"'a' || {a1}"], 3, "key"), ("cmp", f"{first} is not null and {a2} is not null", [first, f"'a' || {a2}"], 3, "key"),
        ("cmp", f"{first} is not null and street_no is not null", [first, "'s' || street_no"], 3, "key"),
        ("cmp", "toks[1] is not null and postal is not null", ["'p' || postal", "substr(toks[1], 1, 3)"], 3, "key"),
        ("cmp", f"street_no is not null and {a1} is not null", ["'s' || street_no", f"'a' || {a1}"], 3, "key"), ("cmp", f"street_no is not null and {a2} is not null", ["'s' || street_no", f"'a' || {a2}"], 3, "key"),
        ("pin", "postal is not null", ["postal"], 2, "key"), ("apair", f"{a2} is not null", [a1, a2], 2, "key"),
    ]
    return _keys(rows, [("tok_n", "rare_name2", 2, "key"), ("tok_a", "print_addr", 2, "key"), *([("ph", "sounds", 1.5, "key")] if sounds else [])], "keys")


def postings(caps: dict[str, int], policy: str) -> str:
    cap = "case " + " ".join(f"when cap_class = '{k}' then {v}" for k, v in caps.items()) + " end"
    place = "count(*) over (partition by key)" if policy == "drop" else "row_number() over (partition by key order by entity_id, key_ord)"
    return f"""q as (select * from keys where entity_id like 'S1-%'),
placed as (select *, {place} as place from keys where entity_id not like 'S1-%'),
posting as (select key, entity_id as cand_id, count(*) over (partition by key) as n_key from placed where place <= {cap})"""


def retrieved(k: int) -> str:
    return f"""scored as (select q.entity_id as s1_id, cand_id, sum(weight) as score, max(weight) as best_key, min(key_ord) as first_ord from q join posting using (key) group by all),
ranked as (select * from (select *, row_number() over (partition by s1_id order by score desc, first_ord, cand_id) - 1 as rank from scored) where rank < {k})"""


def blocked(view: str, cap: int, k: int, policy: str) -> str:
    return f"{parts(view)},\n{keys_v1()},\n{postings({'key': cap}, policy)},\n{retrieved(k)}"


def block_v2(view: str, overgenerate: int, caps: dict[str, int], sounds: bool = False) -> str:
    """CTEs up to over (boosted pairs, ranked)."""
    return f"""{parts(view, sounds)},\n{keys_v2(sounds)},\n{postings(caps, 'truncate')},
sizes as (select country, count(*) as n from parts where entity_id not like 'S1-%' group by 1),
lengths as (select key, max(n_key) as n_key from posting group by 1),
weighted as (select q.* replace (q.weight * ln(1 + n / n_key) as weight) from q join sizes using (country) join lengths using (key)),
scored as (select w.entity_id as s1_id, cand_id, sum(w.weight) as score, min(key_ord) as first_ord from weighted w join posting using (key) group by all),
best as (select entity_id as s1_id, max(weight) as best_key from weighted group by 1),
boosts as (select s.s1_id, s.cand_id, s.score, s.first_ord, (case when a.postal = b.postal then 2.0 else 0.0 end + case when a.street_no = b.street_no then 1.5 else 0.0 end
   + 0.5 * least(len([t for t in b.print_addr if list_contains(a.print_addr, t)]), 2))::double as boost from scored s join parts a on a.entity_id = s.s1_id join parts b on b.entity_id = s.cand_id),
over as (select * from (select s1_id, cand_id, score + boost as score, first_ord, boost, row_number() over (partition by s1_id order by round(score + boost, 9) desc, first_ord, cand_id) - 1 as rank from boosts) where rank < {overgenerate})"""


# --- kernels of pairs and sounds


def words_of(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda t: t <> '')"


def lcs(a: str, b: str) -> str:
    """Longest common subsequence, bit-parallel; texts of up to 120 characters."""
    full = f"((1::hugeint << length({a})) - 1)"
    step = f"((s[1] + (s[1] & m[1])) | (s[1] - (s[1] & m[1]))) & {full}"
    masks = f"list_transform(range(1, length({b}) + 1), lambda j: [list_sum(list_transform(range(length({a})), lambda i: case when substr({a}, (i + 1)::int, 1) = substr({b}, j::int, 1) then 1::hugeint << i::int else 0::hugeint end))::hugeint])"
    last = f"list_reduce({masks}, lambda s, m: [{step}], [{full}])"
    return f"(case when length({a}) = 0 or length({b}) = 0 then 0 else length({a}) - bit_count(({last})[1]) end)"


def kernels(pairs: str, name: str = "kern") -> str:
    """CTEs up to ``name``: x, y, token_sort, token_set of the distinct pairs of texts that ``pairs`` selects as x and y."""
    return f"""{name}0 as (select distinct x, y from ({pairs})),
{name}1 as (select x, y, list_sort({words_of('x')}) as ax, list_sort({words_of('y')}) as ay from {name}0),
{name}2 as (select *, array_to_string(ax, ' ') as sx, array_to_string(ay, ' ') as sy, len(array_to_string(list_intersect(ax, ay), ' ')) as s,
  array_to_string(list_sort(list_distinct(list_filter(ax, lambda t: not list_contains(ay, t)))), ' ') as dx, array_to_string(list_sort(list_distinct(list_filter(ay, lambda t: not list_contains(ax, t)))), ' ') as dy from {name}1),
{name}3 as (select *, {lcs('sx', 'sy')} as l1, {lcs('dx', 'dy')} as l2, s + (s > 0)::int + length(dx) as nx, s + (s > 0)::int + length(dy) as ny from {name}2),
{name} as (select x, y, case when length(sx) + length(sy) = 0 then 1.0 else 2 * l1 / (length(sx) + length(sy))::double end as token_sort,
  case when len(ax) = 0 or len(ay) = 0 then 0.0 when s > 0 and (dx = '' or dy = '') then 1.0
   else greatest(1 - (length(dx) + length(dy) - 2 * l2) / (nx + ny)::double, case when s > 0 then 1 - (1 + length(dx)) / (s + nx)::double else 0 end, case when s > 0 then 1 - (1 + length(dy)) / (s + ny)::double else 0 end) end as token_set from {name}3)"""


def soundex(x: str) -> str:
    w = f"regexp_replace(lower({x}), '[^a-z]', '', 'g')"
    codes = f"translate({w}, 'bfpvcgjkqsxzdtlmnr', '111122222222334556')"
    digits = f"translate(substr({codes}, 1, 1), 'aeiouhwy', '') || translate(substr({codes}, 2), 'aeiouhwy', '')"
    for d in "123456":
        digits = f"regexp_replace({digits}, '{d}+', '{d}', 'g')"
    return f"case when {w} = '' then '' else rpad(upper(substr({w}, 1, 1)) || substr({digits}, 1 + length(translate(substr({codes}, 1, 1), 'aeiouhwy', '')), 3), 4, '0') end"


def metaphone(x: str) -> str:
    """Each letter's code by its neighbours."""
    raw = f"regexp_replace(lower({x}), '[^a-z]', '', 'g')"
    once = f"array_to_string(list_filter(string_split({raw}, ''), lambda c, i: i = 1 or c <> substr({raw}, (i - 1)::int, 1)), '')"
    w = f"(case when substr({once}, 1, 2) in ('ae', 'gn', 'kn', 'pn', 'wr') then substr({once}, 2) else {once} end)"
    c, after, two, before = (f"substr(w, {at})" for at in ("i::int, 1", "(i + 1)::int, 1", "(i + 1)::int, 2", "greatest(i - 1, 1)::int, (i > 1)::int"))
    vowel = lambda t: f"({t} in ('a', 'e', 'i', 'o', 'u'))"
    code = f"""case when {c} = 'h' and {before} in ('c', 'g', 'p', 's', 't') or {c} = 'n' and {before} = 'g' then ''
 when {vowel(c)} then case when i = 1 then upper({c}) else '' end
 when {c} in ('f', 'j', 'l', 'm', 'n', 'r', 'b') then upper({c}) when {c} = 'q' then 'K' when {c} = 'v' then 'F' when {c} = 'z' then 'S'
 when {c} = 'c' then case when {after} = 'h' then 'X' when {after} in ('i', 'e', 'y') then 'S' else 'K' end
 when {c} = 'd' then case when {after} = 'g' then '' else 'T' end
 when {c} = 'g' then case when {after} = 'h' then case when length({two}) = 2 and not {vowel(f"substr({two}, 2, 1)")} then '' else 'K' end when {after} = 'n' then '' else 'K' end
 when {c} = 'h' then case when {vowel(after)} and not {vowel(before)} then 'H' else '' end
 when {c} = 'k' then case when {before} = 'c' then '' else 'K' end
 when {c} = 'p' then case when {after} = 'h' then 'F' else 'P' end
 when {c} = 's' then case when {after} = 'h' or {two} in ('io', 'ia') then 'X' else 'S' end
 when {c} = 't' then case when {after} = 'h' then '0' when {two} in ('io', 'ia') then 'X' else 'T' end
 when {c} in ('w', 'y') then case when {vowel(after)} then upper({c}) else '' end
 when {c} = 'x' then 'KS' else '' end"""
    return f"(select array_to_string(list_slice(list_filter(list_transform(range(1, length(w) + 1), lambda i: {code}), lambda z: z <> ''), 1, 6), '') from (select {w} as w))"


def coded(tokens: str, table: str) -> str:
    """CTEs word_codes: word, sdx, mph of every distinct word and whole name of ``table``."""
    return f"""code_words as (select distinct word from (select unnest({tokens}) as word from {table} union all select name_clean from {table})),
word_codes as (select word, {soundex('word')} as sdx, {metaphone('word')} as mph from code_words)"""


def term_vectors() -> str:
    """CTEs over parts: cf (of the targets) and vec (entity_id, term, w: unit vectors of name and address tokens)."""
    return """all_terms as (select entity_id, country, unnest(list_concat(['n:' || t for t in toks], ['a:' || t for t in addr_tokens])) as term from parts),
cf as (select country, term, count(*) as cf from all_terms where entity_id not like 'S1-%' group by all),
totals as (select country, substr(term, 1, 2) as field, sum(cf) as total from cf group by all),
raw as (select entity_id, t.country, t.term, count(*) * ln(1 + coalesce(max(total), 1) / coalesce(max(cf), 1)) as w from all_terms t left join cf using (country, term) left join totals x on x.country = t.country and x.field = substr(t.term, 1, 2) group by 1, 2, 3),
vec as (select entity_id, term, w / sqrt(sum(w * w) over (partition by entity_id)) as w from raw)"""


def reranked(k: int) -> str:
    """CTEs behind block_v2: reranked (all parts of the blend, final, rank), the first ``k`` of each s1_id."""
    return f"""{term_vectors()},
cosine as (select s1_id, cand_id, sum(a.w * b.w) as cosine from over join vec a on a.entity_id = s1_id join vec b on b.entity_id = cand_id and a.term = b.term group by 1, 2),
sides as (select o.*, best_key, a.clean as qn, b.clean as tn, array_to_string(a.addr_tokens, ' ') as qa, array_to_string(b.addr_tokens, ' ') as ta from over o join best using (s1_id) join parts a on a.entity_id = s1_id join parts b on b.entity_id = cand_id),
{kernels("select qn as x, tn as y from sides union all select qa, ta from sides")},
blend as (select s.s1_id, s.cand_id, s.score, s.first_ord, s.boost, s.best_key, coalesce(cosine, 0.0) as cosine, n.token_set as fuzzy_name, a.token_set as fuzzy_addr, least(s.score / (best_key + 4.5), 1.0) as key_share
  from sides s left join cosine using (s1_id, cand_id) join kern n on n.x = qn and n.y = tn join kern a on a.x = qa and a.y = ta),
finals as (select *, 0.4 * least(cosine * 1.4, 1.0) + 0.2 * fuzzy_addr + 0.4 * key_share as final from blend),
reranked as (select * from (select *, row_number() over (partition by s1_id order by round(final, 9) desc, cand_id) - 1 as rank from finals) where rank < {k})"""
