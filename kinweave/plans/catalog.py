"""The registered queries, each with the SQL of another engine that it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import similarity as S
from ..functions import text as X
from ..operators import assignment, blocking, features, labels, metrics, mining, models, sampling, validation, weights
from ..operators.represent import represent, with_phonetics
from ..sources import records as R
from ..sources import sinks, staging
from . import oracle as O

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

TRUTH_DOC = """truth as (select s1_id, concat('S', cast(1 + doc_id % 3 as varchar), '-', lpad(cast(doc_id as varchar), 7, '0')) as cand_id
  from (select text, min(concat('S1-', lpad(cast(doc_id as varchar), 7, '0'))) as s1_id from documents where doc_id % 3 = 0 group by 1) join documents using (text) where doc_id % 3 <> 0)"""
#: The caps and list lengths of use: first generation cut or skipped, second generation.
V1_CAP, V1_K, DROP_CAP, DROP_K, V2_OVER, V2_CAPS, RERANK_K = 300, 35, 500, 40, blocking.OVERGENERATE, blocking.CAPS, 100
BLOCKED = O.blocked(O.DOC, V1_CAP, V1_K, "truncate")
PROBS = f"{BLOCKED},\nprobs as (select s1_id, cand_id, rank, round(score / (score + 4.0), 4) as prob, count(*) over (partition by s1_id) as n_pairs from ranked)"
S1 = "s1 as (select entity_id as s1_id, country from parts where entity_id like 'S1-%')"


def query(sql: str | None = None):
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def part(spark: SparkSession, d: str) -> DataFrame:
    return R.entity_part(spark, d)


def doc(spark: SparkSession, d: str) -> DataFrame:
    return R.entity_doc(spark, d)


# --- sources, set operations, joins


@query(f"with rec as ({O.PART}) select * from rec")
def scan_records(spark, d):
    return part(spark, d)


@query(f"with rec as ({O.PART}) select * from rec where entity_id like 'S2-%' union all select * from rec where entity_id like 'S3-%'")
def union_targets(spark, d):
    p = part(spark, d)
    return R.union_targets(p.filter(F.col("entity_id").startswith("S2-")), p.filter(F.col("entity_id").startswith("S3-")))


@query(f"with rec as ({O.PART}) select entity_id, min(business_name) as business_name, min(business_address) as business_address, min(country) as country from (select * from rec union all select * from rec where entity_id like 'S3-%') group by 1")
def union_dedupe(spark, d):
    p = part(spark, d)
    return R.union_dedupe(p, p.filter(F.col("entity_id").startswith("S3-")))


@query(f"with rec as ({O.DOC}), {TRUTH_DOC} select entity_id, business_name from rec where entity_id in (select s1_id from truth)")
def semi_ids(spark, d):
    ids = R.truth_doc(spark, d).select(F.col("s1_id").alias("entity_id"))
    return doc(spark, d).join(ids, "entity_id", "left_semi").select("entity_id", "business_name")


@query(f"with rec as ({O.DOC}), {TRUTH_DOC} select entity_id, business_name from rec where entity_id like 'S1-%' and entity_id not in (select s1_id from truth)")
def anti_ids(spark, d):
    s1, _ = R.split_sources(doc(spark, d))
    ids = R.truth_doc(spark, d).select(F.col("s1_id").alias("entity_id"))
    return s1.join(ids, "entity_id", "left_anti").select("entity_id", "business_name")


@query(f"with rec as ({O.DOC}), {TRUTH_DOC} select entity_id, country, string_agg(cand_id, ',' order by cand_id) as matched from rec left join truth on entity_id = s1_id where entity_id like 'S1-%' group by 1, 2")
def left_country(spark, d):
    s1, _ = R.split_sources(doc(spark, d))
    lists = R.truth_doc(spark, d).groupBy(F.col("s1_id").alias("entity_id")).agg(F.array_join(F.array_sort(F.collect_list("cand_id")), ",").alias("matched"))
    return s1.join(lists, "entity_id", "left").select("entity_id", "country", "matched")


@query(f"with rec as ({O.DOC}), {TRUTH_DOC}, n as (select s1_id, count(*) as n from truth group by 1) select entity_id, country, n > 1 as several from rec join n on entity_id = s1_id")
def inner_flag(spark, d):
    n = R.truth_doc(spark, d).groupBy(F.col("s1_id").alias("entity_id")).agg(F.count(F.lit(1)).alias("n"))
    return doc(spark, d).join(n, "entity_id").select("entity_id", "country", (F.col("n") > 1).alias("several"))


@query(f"with rec as ({O.DOC}), {TRUTH_DOC}, lists as (select s1_id as source1_entity_id, string_agg(cand_id, ', ' order by cand_id) as ids from truth group by 1) select distinct source1_entity_id as s1_id, unnest(string_split(ids, ', ')) as cand_id from lists")
def id_list_parse(spark, d):
    lists = R.truth_doc(spark, d).groupBy(F.col("s1_id").alias("source1_entity_id")).agg(F.concat(F.array_join(F.array_sort(F.collect_list("cand_id")), ", "), F.lit(",")).alias("matched_entity_ids"))
    return R.long_pairs(lists)


# --- normalisation


def _norm(view):
    return f"with {O.rep(view)}"


@query(f"{_norm(O.DOC)} select entity_id, name_clean, compressed, acronym_all, to_json(name_tokens) as tokens from rep")
def clean_name(spark, d):
    return represent(doc(spark, d)).select("entity_id", "name_clean", "compressed", "acronym_all", F.to_json("name_tokens").alias("tokens"))


#: Names in several scripts and what they are in Latin letters.
SCRIPTS = {
    "Москва Щукин": "moskva shchukin", "Ελλάδα ψωμί": "ellada psomi", "שלום": "shlvm", "النور": "alnwr", "टाटा प्राइवेट": "ttaattaa pvt", "カタカナ トヨタ": "katakana toyota",
    "서울 한국": "seoul hangug", "กรุงเทพ": "krungethph", "ＡＢＣ １２": "abc 12", "ŠKODA Łódź": "skoda lodz", "中文": "中文",
}


@query(f"select n_nationkey::long as n_nationkey, i, lower(n_name) || ' ' || latin as name_clean from nation, (values {', '.join(f'({i}, {O.quoted(v)})' for i, v in enumerate(SCRIPTS.values()))}) as names(i, latin)")
def names_in_scripts(spark, d):
    each = F.posexplode(F.array(*map(F.lit, SCRIPTS))).alias("i", "name")
    rows = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name", each)
    records = rows.select(F.concat_ws("-", "n_nationkey", "i").alias("entity_id"), F.concat_ws(" ", "n_name", "name").alias("business_name"), F.lit(None).cast("string").alias("business_address"), F.lit("").alias("country"))
    clean = represent(records).select("name_clean", F.split("entity_id", "-").alias("k"))
    return clean.select(F.col("k")[0].cast("long").alias("n_nationkey"), F.col("k")[1].cast("int").alias("i"), "name_clean")


@query(f"{_norm(O.PART)} select entity_id, addr_clean, to_json(addr_tokens) as tokens from rep")
def clean_address(spark, d):
    return represent(part(spark, d)).select("entity_id", "addr_clean", F.to_json("addr_tokens").alias("tokens"))


@query(f"{_norm(O.PART)} select entity_id, postal from rep union all ({_norm(O.DOC)} select entity_id, postal from rep)")
def postal_code(spark, d):
    return represent(part(spark, d)).select("entity_id", "postal").unionByName(represent(doc(spark, d)).select("entity_id", "postal"))


@query(f"{_norm(O.DOC)} select entity_id, street_no from rep")
def street_number(spark, d):
    return represent(doc(spark, d)).select("entity_id", "street_no")


_NEAR = "concat('12B, ', business_address, ', near ', business_name, ', Opp ', country)"


@query(f"with rec as ({O.PART}), x as (select entity_id, {O.base(_NEAR)} as a from rec) select entity_id, trim({O.group('a', L.LANDMARK)}) as landmark, {O.group('a', L.STREET_NUMBER)} as street_no from x")
def landmark(spark, d):
    a = X.basic_clean(F.expr(_NEAR))
    return part(spark, d).select("entity_id", X.landmark(a).alias("landmark"), X.street_number(a).alias("street_no"))


@query(f"with rec as ({O.PART} union all {O.DOC}) select country as raw, {O.country('country')} as country, count(*) as n from rec group by 1, 2")
def country_norm(spark, d):
    return part(spark, d).unionByName(doc(spark, d)).groupBy(F.col("country").alias("raw")).agg(F.count(F.lit(1)).alias("n")).select("raw", X.country(F.col("raw")).alias("country"), "n")


@query(f"select page_id, {O.strip_domain('url')} as host from pages")
def strip_domain(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", X.strip_domain(F.col("url")).alias("host"))


_PLOT = "concat('Plot No. ', business_address, ' shop-', entity_id)"


@query(f"with rec as ({O.PART}) select entity_id, {O.group(_PLOT, L.PLOT)} as plot from rec")
def plot_number(spark, d):
    return part(spark, d).select("entity_id", X.plot_number(F.expr(_PLOT)).alias("plot"))


@query(f"with {O.parts(O.DOC)} select entity_id, postal, street_no, to_json(print_addr) as rare from parts")
def fingerprint(spark, d):
    return blocking.key_parts(doc(spark, d)).select("entity_id", "postal", "street_no", F.to_json("print_addr").alias("rare"))


@query(f"{_norm(O.DOC)} select entity_id, acronym, acronym_all from rep")
def acronym(spark, d):
    return represent(doc(spark, d)).select("entity_id", "acronym", "acronym_all")


@query(f"select c_custkey, {O.name_tokens(O.base('c_name'))}[1] as first_token, len({O.name_tokens(O.base('c_name'))}) as n_tokens from customer")
def customer_tokens(spark, d):
    t = X.name_tokens(X.basic_clean(F.col("c_name")))
    return spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", F.get(t, F.lit(0)).alias("first_token"), F.size(t).cast("long").alias("n_tokens"))


# --- blocking


def _doc_sides(spark, d):
    return R.split_sources(doc(spark, d))


def _ranked(spark, d, view=doc, cap=V1_CAP, k=V1_K, policy="truncate"):
    s1, targets = R.split_sources(view(spark, d))
    return blocking.block_v1(s1, targets, cap, k, policy)


@query(f"with {O.parts(O.DOC)},\n{O.keys_v1()} select entity_id, key_ord, kind, key, weight from keys")
def block_keys(spark, d):
    return blocking.keys_v1(blocking.key_parts(doc(spark, d))).select("entity_id", F.col("key_ord").cast("long").alias("key_ord"), "kind", "key", "weight")


@query(f"with {O.parts(O.PART)},\n{O.keys_v2()} select entity_id, key_ord, kind, key, weight from keys")
def block_keys_second(spark, d):
    return blocking.keys_v2(blocking.key_parts(part(spark, d)), phonetic=False).select("entity_id", F.col("key_ord").cast("long").alias("key_ord"), "kind", "key", "weight")


@query(f"with {O.blocked(O.PART, DROP_CAP, DROP_K, 'drop')} select s1_id, cand_id, score, rank from ranked")
def block_drop(spark, d):
    return _ranked(spark, d, part, DROP_CAP, DROP_K, "drop").select("s1_id", "cand_id", "score", F.col("rank").cast("long").alias("rank"))


@query(f"with {BLOCKED} select s1_id, cand_id, score, rank from ranked")
def block_truncate(spark, d):
    return _ranked(spark, d).select("s1_id", "cand_id", "score", F.col("rank").cast("long").alias("rank"))


def _over(spark, d, view=doc):
    s1, targets = R.split_sources(view(spark, d))
    return blocking.block_v2(staging.table(blocking.key_parts(s1)), staging.table(blocking.key_parts(targets)), V2_OVER, V2_CAPS, phonetic=False)


@query(f"with {O.block_v2(O.DOC, V2_OVER, V2_CAPS)} select entity_id as s1_id, key, round(weight, 6) as weight from weighted")
def block_idf(spark, d):
    s1, targets = _doc_sides(spark, d)
    q, t = blocking.key_parts(s1), blocking.key_parts(targets)
    posting = blocking.postings(blocking.keys_v2(t, False), V2_CAPS, "truncate")
    sizes = t.groupBy("country").agg(F.count(F.lit(1)).alias("n"))
    return blocking.idf_weights(blocking.keys_v2(q, False), posting, sizes).select(F.col("entity_id").alias("s1_id"), "key", F.round("weight", 6).alias("weight"))


@query(f"with {O.block_v2(O.DOC, V2_OVER, V2_CAPS)} select s1_id, cand_id, boost, round(score, 6) as score from over where boost > 0")
def addr_boost(spark, d):
    return _over(spark, d).filter(F.col("boost") > 0).select("s1_id", "cand_id", "boost", F.round("score", 6).alias("score"))


@query(f"with {O.block_v2(O.DOC, V2_OVER, V2_CAPS)} select s1_id, cand_id, rank, round(o.score, 6) as score, round(best_key, 6) as best_key from over o join best using (s1_id)")
def overgenerate(spark, d):
    return _over(spark, d).select("s1_id", "cand_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"), F.round("best_key", 6).alias("best_key"))


@query(f"with {O.block_v2(O.DOC, V2_OVER, V2_CAPS)},\n{O.term_vectors()} select s1_id, cand_id, round(sum(a.w * b.w), 6) as cosine from over join vec a on a.entity_id = s1_id join vec b on b.entity_id = cand_id and a.term = b.term group by 1, 2")
def rerank_cosine(spark, d):
    return blocking.block_cosines(*_parts(spark, d), V2_OVER, V2_CAPS, phonetic=False).select("s1_id", "cand_id", F.round("cosine", 6).alias("cosine"))


def _parts(spark, d):
    """Both sides' key parts, stored once: keys, boosts, terms and texts are all made of them."""
    s1, targets = _doc_sides(spark, d)
    return staging.table(blocking.key_parts(s1)), staging.table(blocking.key_parts(targets))


_BLEND = ["score", "best_key", "cosine", "fuzzy_name", "fuzzy_addr", "key_share", "final"]


@query(f"with {O.block_v2(O.DOC, V2_OVER, V2_CAPS, sounds=True)},\n{O.reranked(RERANK_K)} select s1_id, cand_id, rank, {', '.join(f'round({c}, 6) as {c}' for c in _BLEND)} from reranked")
def rerank_topk(spark, d):
    rows = blocking.block_rerank(*_parts(spark, d), RERANK_K, V2_OVER, V2_CAPS)
    return rows.select("s1_id", "cand_id", F.col("rank").cast("long").alias("rank"), *[F.round(c, 6).alias(c) for c in _BLEND])


@query(f"with {O.parts(O.DOC)},\n{O.keys_v1()},\n{TRUTH_DOC}, hit as (select distinct q.kind, s1_id, cand_id from truth join keys q on q.entity_id = s1_id join keys t on t.entity_id = cand_id and t.key = q.key), both_ as (select kind, count(*) as hits from hit group by 1 union all select 'any', count(*) from (select distinct s1_id, cand_id from hit)) select kind, hits, round(hits / greatest((select count(*) from truth), 1)::double, 6) as recall from both_")
def key_recall(spark, d):
    s1, targets = _doc_sides(spark, d)
    k = lambda x: blocking.keys_v1(blocking.key_parts(x))
    return blocking.key_recall(k(s1), k(targets), R.truth_doc(spark, d)).withColumn("recall", F.round("recall", 6))


@query(f"with {O.parts(O.DOC)},\n{O.keys_v1()},\n{TRUTH_DOC}, hit as (select distinct s1_id, cand_id from truth join keys q on q.entity_id = s1_id join keys t on t.entity_id = cand_id and t.key = q.key) select s1_id, cand_id from truth where (s1_id, cand_id) not in (select (s1_id, cand_id) from hit) order by 1, 2 limit 10")
def key_misses(spark, d):
    s1, targets = _doc_sides(spark, d)
    k = lambda x: blocking.keys_v1(blocking.key_parts(x))
    return blocking.key_misses(k(s1), k(targets), R.truth_doc(spark, d))


_GRID = ", ".join("(" + ", ".join(map(str, w)) + ")" for w in blocking.blend_grid())


@query(f"""with {O.block_v2(O.DOC, V2_OVER, V2_CAPS, sounds=True)},\n{O.reranked(V2_OVER)},\n{TRUTH_DOC}, grid(w_cosine, w_name, w_addr, w_keys) as (values {_GRID}),
tried as (select g.*, s1_id, cand_id, row_number() over (partition by w_cosine, w_name, w_addr, w_keys, s1_id order by round(w_cosine * least(cosine * 1.4, 1.0) + w_name * fuzzy_name + w_addr * fuzzy_addr + w_keys * key_share, 9) desc, cand_id) as place from reranked, grid g),
hit as (select tried.*, t.s1_id is not null as t from tried left join truth t using (s1_id, cand_id)), n as (select count(*) as n from truth)
select w_cosine::double as w_cosine, w_name::double as w_name, w_addr::double as w_addr, w_keys::double as w_keys, k::int as k, count(*) filter (where place <= k and t) as hits, round(count(*) filter (where place <= k and t) / greatest(max(n), 1)::double, 6) as recall
from hit, n, (select unnest([30, 100]) as k) group by all""")
def tune_rerank(spark, d):
    q, t = _parts(spark, d)
    rows = blocking.rerank(blocking.block_v2(q, t, V2_OVER, V2_CAPS), q, t, V2_OVER)
    return blocking.tune_blend(rows, R.truth_doc(spark, d), ks=(30, 100)).withColumn("recall", F.round("recall", 6))


# --- pair features


def _pairs_sql(select: str) -> str:
    return f"with {PROBS},\nrep0 as (select 1),\n{_rep_after()} select p.s1_id, p.cand_id, {select} from ranked p join rep a on a.entity_id = s1_id join rep b on b.entity_id = cand_id"


def _rep_after() -> str:
    return O.rep(O.DOC).replace("rec as (", "rec2 as (", 1).replace(" from rec)", " from rec2)")


BUILT_IN_SQL: dict[str, str] = {}


def _pair_query(columns: dict[str, str]):
    """A query of built-in features and their SQL."""
    BUILT_IN_SQL.update(columns)
    sql = _pairs_sql(", ".join(f"{e} as {n}" for n, e in columns.items()))

    def put(f):
        def run(spark, d):
            s1, targets = R.split_sources(represent(doc(spark, d)))
            rows = features.paired(_ranked(spark, d), s1, targets)
            made = features.built_in(F.col("rank"), F.col("score"))
            return rows.select("s1_id", "cand_id", *[F.round(made[n], 6).alias(n) for n in columns])

        run.__name__ = f.__name__
        return query(sql)(run)

    return put


def _r(x: str) -> str:
    return f"round(({x})::double, 6)"


def _flag(x: str) -> str:
    return f"(case when {x} then 1.0 else 0.0 end)::double"


_BOTH = "a.addr_clean <> '' and b.addr_clean <> ''"


def _short(x: str, y: str) -> str:
    return f"(length({x}.acronym) >= 2 and ({x}.acronym = {y}.compressed or list_contains({y}.name_set, {x}.acronym)))"


def _agree(x: str) -> str:
    return f"(case when a.{x} is null or b.{x} is null then 0.0 when a.{x} = b.{x} then 1.0 else -1.0 end)::double"


@_pair_query({"name_acronym_match": _flag(f"{_short('a', 'b')} or {_short('b', 'a')}")})
def acronym_match(): ...


@_pair_query({"name_prefix4_match": _flag("a.prefix4 <> '' and a.prefix4 = b.prefix4"), "name_exact_match": _flag("a.name_clean <> '' and a.name_clean = b.name_clean"), "name_comp_exact": _flag("a.compressed <> '' and a.compressed = b.compressed")})
def prefix4(): ...


@_pair_query({"name_len_diff": _r("abs(length(a.name_clean) - length(b.name_clean))"), "name_len_ratio": _r("least(length(a.name_clean), length(b.name_clean)) / greatest(length(a.name_clean), length(b.name_clean), 1)::double")})
def len_ratio(): ...


@_pair_query({"name_char3_jaccard": _r(O.jaccard("a.name_char3", "b.name_char3")), "addr_char3_jaccard": _r(f"case when {_BOTH} then {O.jaccard('a.addr_char3', 'b.addr_char3')} else 0.0 end")})
def char3_jaccard(): ...


@_pair_query({"name_token_jaccard": _r(O.jaccard("a.name_set", "b.name_set")), "addr_token_jaccard": _r(f"case when {_BOTH} then {O.jaccard('a.addr_set', 'b.addr_set')} else 0.0 end")})
def token_jaccard(): ...


@_pair_query({"name_token_containment": _r(O.containment("a.name_set", "b.name_set")), "addr_token_containment": _r(f"case when {_BOTH} then {O.containment('a.addr_set', 'b.addr_set')} else 0.0 end")})
def token_containment(): ...


@_pair_query({"name_comp_substr": _flag("a.compressed <> '' and b.compressed <> '' and (contains(a.compressed, b.compressed) or contains(b.compressed, a.compressed))")})
def substring_match(): ...


@_pair_query({"pin_match": _agree("postal"), "pin_both_present": _flag("a.postal is not null and b.postal is not null"), "pin_disagree": _flag("a.postal <> b.postal")})
def pin_flags(): ...


@_pair_query({"st_num_match": _agree("street_no"), "st_num_both_present": _flag("a.street_no is not null and b.street_no is not null"), "st_num_disagree": _flag("a.street_no <> b.street_no")})
def street_flags(): ...


@_pair_query({"addr_s1_missing": _flag("a.addr_clean = ''"), "addr_cand_missing": _flag("b.addr_clean = ''"), "addr_both_present": _flag(_BOTH), "cand_source_is_s2": _flag("b.entity_id like 'S2-%'"), "cand_rank": "p.rank::double", "cand_blocking_score": "p.score::double"})
def addr_presence(): ...


@_pair_query({"name_lev_ratio": _r("case when greatest(length(a.name_clean), length(b.name_clean)) = 0 then 1.0 else 1 - levenshtein(a.name_clean, b.name_clean) / greatest(length(a.name_clean), length(b.name_clean))::double end")})
def levenshtein_sim(): ...


_KERN = O.kernels("select a.name_clean as x, b.name_clean as y from ranked join rep a on a.entity_id = s1_id join rep b on b.entity_id = cand_id union all select a.addr_clean, b.addr_clean from ranked join rep a on a.entity_id = s1_id join rep b on b.entity_id = cand_id")


def _jw(x: str) -> str:
    return f"case when a.{x} = '' and b.{x} = '' then 1.0 else jaro_winkler_similarity(a.{x}, b.{x}) end"


KERNEL_SQL = {
    "name_jw": _jw("name_clean"), "name_token_sort": "kn.token_sort", "name_token_set": "kn.token_set", "name_sorted_jw": _jw("name_sorted"), "addr_jw": f"case when {_BOTH} then jaro_winkler_similarity(a.addr_clean, b.addr_clean) else 0.0 end",
    "addr_token_sort": f"case when {_BOTH} then ka.token_sort else 0.0 end", "addr_token_set": f"case when {_BOTH} then ka.token_set else 0.0 end",
}


def _kernel_sql(columns: dict[str, str], more: str = "", joins: str = "") -> str:
    return f"with {PROBS},\n{_rep_after()},\n{_KERN}{more} select p.s1_id, p.cand_id, {', '.join(f'{_r(e)} as {n}' for n, e in columns.items())} from ranked p join rep a on a.entity_id = p.s1_id join rep b on b.entity_id = p.cand_id join kern kn on kn.x = a.name_clean and kn.y = b.name_clean join kern ka on ka.x = a.addr_clean and ka.y = b.addr_clean {joins}"


def _six(rows: DataFrame, columns) -> DataFrame:
    return rows.select("s1_id", "cand_id", *[F.round(c, 6).alias(c) for c in columns])


@query(_pairs_sql(_r(KERNEL_SQL["name_jw"]) + " as name_jw, " + _r(KERNEL_SQL["addr_jw"]) + " as addr_jw"))
def jaro_winkler_sim(spark, d):
    return _six(_all_basic(spark, d), ["name_jw", "addr_jw"])


def _all_basic(spark, d):
    s1, targets = R.split_sources(staging.table(represent(doc(spark, d))))
    return features.features(_ranked(spark, d), s1, targets)


def _some(*names: str) -> dict[str, str]:
    return {n: KERNEL_SQL[n] for n in names}


@query(_kernel_sql(_some("name_token_sort", "name_sorted_jw", "addr_token_sort")))
def token_sort_sim(spark, d):
    return _six(_all_basic(spark, d), ["name_token_sort", "name_sorted_jw", "addr_token_sort"])


@query(_kernel_sql(_some("name_token_set", "addr_token_set")))
def token_set_sim(spark, d):
    return _six(_all_basic(spark, d), ["name_token_set", "addr_token_set"])


@query(_kernel_sql(BUILT_IN_SQL | KERNEL_SQL))
def features_basic(spark, d):
    return _six(_all_basic(spark, d), features.BASE_FEATURES)


def _phonetic_records(spark, d):
    return with_phonetics(represent(doc(spark, d)))


_CODED = O.coded("name_tokens", "rep") + """,
sounds as (select r.entity_id, any_value(w.sdx) as name_soundex, any_value(w.mph) as name_metaphone from rep r join word_codes w on w.word = r.name_clean group by 1),
lists as (select entity_id, list(mph order by i) as name_codes from (select entity_id, i, name_tokens[i] as word from (select *, unnest(range(1, len(name_tokens) + 1)) as i from rep)) join word_codes using (word) group by 1),
codes as (select s.*, coalesce(name_codes, []) as name_codes from sounds s left join lists using (entity_id))"""


@query(f"{_norm(O.DOC)},\n{_CODED} select entity_id, name_soundex from codes")
def soundex_code(spark, d):
    return _phonetic_records(spark, d).select("entity_id", "name_soundex")


@query(f"{_norm(O.DOC)},\n{_CODED} select entity_id, name_metaphone, to_json(name_codes) as name_codes from codes")
def metaphone_code(spark, d):
    return _phonetic_records(spark, d).select("entity_id", "name_metaphone", F.to_json("name_codes").alias("name_codes"))


_SHORT, _LONG = ("case when len(ca.name_codes) > len(cb.name_codes) then {} else {} end".format(*x) for x in (("cb.name_codes", "ca.name_codes"), ("ca.name_codes", "cb.name_codes")))
PHONETIC_SQL = {f"name_{k}_match": _flag(f"ca.name_{k} <> '' and ca.name_{k} = cb.name_{k}") for k in ("metaphone", "soundex")} | {
    "name_phonetic_token_ratio": f"case when len({_SHORT}) = 0 then 0.0 else len(list_filter({_SHORT}, lambda x: x <> '' and list_contains({_LONG}, x))) / len({_SHORT})::double end",
}
_CODES_JOIN = "join codes ca on ca.entity_id = p.s1_id join codes cb on cb.entity_id = p.cand_id"


@query(f"with {BLOCKED},\n{_rep_after()},\n{_CODED} select p.s1_id, p.cand_id, {', '.join(f'{_r(e)} as {n}' for n, e in PHONETIC_SQL.items())} from ranked p {_CODES_JOIN}")
def phonetic_ratio(spark, d):
    s1, targets = R.split_sources(_phonetic_records(spark, d))
    rows = features.paired(_ranked(spark, d), s1, targets, phonetic=True)
    return rows.select("s1_id", "cand_id", *[F.round(x, 6).alias(n) for n, x in features.phonetics().items()])


def _term_ctes(p: str, tokens: str) -> str:
    """CTEs {p}shared: cosine c, BM25 bm and highest idf m of the pairs that share a term."""
    return f"""{p}df as (select country, term, count(*) as df from (select country, unnest(list_distinct({tokens})) as term from rep where entity_id not like 'S1-%') group by all),
{p}idf as (select country, term, ln((1 + n) / (1 + df)) + 1 as idf from (select *, row_number() over (partition by country order by df desc, term) as place from {p}df) join (select country, count(*) as n from rep where entity_id not like 'S1-%' group by 1) using (country) where place <= {weights.VOCABULARY}),
{p}tf as (select entity_id, country, term, count(*) as tf, max(length) as length from (select entity_id, country, len({tokens}) as length, unnest({tokens}) as term from rep) group by all),
{p}vec as (select t.*, idf, (1 + ln(tf)) * idf / sqrt(sum(pow((1 + ln(tf)) * idf, 2)) over (partition by entity_id)) as u from {p}tf t join {p}idf using (country, term)),
{p}shared as (select s1_id, cand_id, sum(a.u * b.u) as c, sum(a.idf * b.tf * 2.5 / (b.tf + 1.5 * (0.25 + 0.75 * b.length / 5.0))) as bm, max(a.idf) as m from ranked join {p}vec a on a.entity_id = s1_id join {p}vec b on b.entity_id = cand_id and a.term = b.term group by 1, 2)"""


RELATIONAL_SQL = {f"{p}_{n}": f"coalesce({p[0]}s.{x}, 0)" for p in ("name", "addr") for n, x in (("tfidf_cosine", "c"), ("bm25", "bm"), ("max_shared_idf", "m"))}


@query(_kernel_sql(BUILT_IN_SQL | KERNEL_SQL | RELATIONAL_SQL | PHONETIC_SQL, f",\n{_CODED},\n{_term_ctes('n', 'name_tokens')},\n{_term_ctes('a', 'addr_tokens')}", f"{_CODES_JOIN} left join nshared ns on ns.s1_id = p.s1_id and ns.cand_id = p.cand_id left join ashared as_ on as_.s1_id = p.s1_id and as_.cand_id = p.cand_id").replace("coalesce(as.", "coalesce(as_."))
def features_all(spark, d):
    s1, targets = R.split_sources(staging.table(_phonetic_records(spark, d)))
    rows = features.features(_ranked(spark, d), s1, targets, (weights.fit_idf(targets, "name_tokens"), weights.fit_idf(targets, "addr_tokens")))
    return _six(rows, features.ALL_FEATURES)


# --- TF-IDF and BM25


def _idf_sql(tokens: str, most: int = weights.VOCABULARY) -> str:
    return f"""targets as (select * from rep where entity_id not like 'S1-%'),
df as (select country, term, count(*) as df from (select country, unnest(list_distinct({tokens})) as term from targets) group by all),
idf as (select country, term, df, ln((1 + n) / (1 + df)) + 1 as idf from (select *, row_number() over (partition by country order by df desc, term) as place from df) join (select country, count(*) as n from targets group by 1) using (country) where place <= {most})"""


@query(f"{_norm(O.DOC)},\n{_idf_sql('name_tokens', 500)} select country, term, df, round(idf, 6) as idf from idf")
def tfidf_fit(spark, d):
    _, targets = R.split_sources(represent(doc(spark, d)))
    return weights.fit_idf(targets, "name_tokens", 500).withColumn("idf", F.round("idf", 6))


@query(f"""{_norm(O.DOC)}, t as (select country, unnest(name_tokens) as term from rep where entity_id not like 'S1-%'), df as (select country, term, count(*) as df from t group by all)
select country, term, df, round(ln((1 + n) / (1 + df)) + 1, 6) as idf from (select *, row_number() over (partition by country order by df desc, term) as place from df) join (select country, count(*) as n from rep where entity_id not like 'S1-%' group by 1) using (country) where place <= {weights.VOCABULARY}""")
def idf_from_counts(spark, d):
    _, targets = R.split_sources(represent(doc(spark, d)))
    return weights.fit_idf(targets, "name_tokens", df_mode="occurrence").withColumn("idf", F.round("idf", 6))


_WEIGHTS = f"with {BLOCKED},\n{_rep_after()},\n{_term_ctes('n', 'name_tokens')} select s1_id, cand_id, [column] from ranked left join nshared using (s1_id, cand_id)"


def _name_scores(spark, d):
    s1, targets = R.split_sources(staging.table(represent(doc(spark, d))))
    return weights.pair_scores(_ranked(spark, d), s1, targets, "name_tokens", weights.fit_idf(targets, "name_tokens"), "name")


@query(_WEIGHTS.replace("[column]", "round(coalesce(c, 0), 6) as name_tfidf_cosine"))
def tfidf_cosine(spark, d):
    return _name_scores(spark, d).select("s1_id", "cand_id", F.round("name_tfidf_cosine", 6).alias("name_tfidf_cosine"))


@query(_WEIGHTS.replace("[column]", "round(coalesce(bm, 0), 6) as name_bm25"))
def bm25(spark, d):
    return _name_scores(spark, d).select("s1_id", "cand_id", F.round("name_bm25", 6).alias("name_bm25"))


@query(_WEIGHTS.replace("[column]", "round(coalesce(m, 0), 6) as name_max_shared_idf"))
def max_shared_idf(spark, d):
    return _name_scores(spark, d).select("s1_id", "cand_id", F.round("name_max_shared_idf", 6).alias("name_max_shared_idf"))


@query(f"with {O.parts(O.PART)}, t as (select country, unnest(list_concat(['n:' || t for t in toks], ['a:' || t for t in addr_tokens])) as term from parts) select country, term, count(*) as cf from t group by all")
def collection_frequency(spark, d):
    return blocking.collection_frequency(blocking.key_parts(part(spark, d)))


# --- assignment and metrics


def _probs(spark, d):
    return assignment.with_counts(_ranked(spark, d).select("s1_id", "cand_id", F.col("rank").cast("long").alias("rank"), F.round(F.col("score") / (F.col("score") + 4.0), 4).alias("prob")))


def _assigned(threshold: float, margin: float, source: str = "probs") -> str:
    limit = f"case when n_pairs = 1 then {round(threshold + margin, 9)} else {threshold} end"
    return f"matched as (select s1_id, cand_id, prob from (select *, row_number() over (partition by cand_id order by prob desc, s1_id) as place from {source} where prob >= {limit}) where place = 1)"


@query(f"with {PROBS},\n{_assigned(0.65, 0.0)} select s1_id, cand_id, prob from matched")
def assign_argmax(spark, d):
    return assignment.assign(_probs(spark, d), 0.65, 0.0).select("s1_id", "cand_id", "prob")


@query(f"with {PROBS},\n{_assigned(0.7, 0.05)},\n{S1} select s1.s1_id, coalesce(string_agg(cand_id, ',' order by cand_id), '') as matches from s1 left join matched using (s1_id) group by 1")
def assign_margin(spark, d):
    s1, _ = _doc_sides(spark, d)
    return assignment.matches_of_all(s1, assignment.assign(_probs(spark, d), 0.7)).select("s1_id", F.array_join("matches", ",").alias("matches"))


@query(f"with {PROBS} select s1_id, cand_id, prob from probs where prob >= greatest(0.2, 0.8 - 0.15)")
def retention(spark, d):
    return assignment.retain(_probs(spark, d), 0.8).select("s1_id", "cand_id", "prob")


def _f05(ids: str, truth: str, pred: str, keys: str = "s1_id") -> str:
    return f"""marks as (select {keys}, cand_id, max(t) as t, max(p) as p from (select distinct {keys}, cand_id, 1 as t, 0 as p from {truth} union all select distinct {keys}, cand_id, 0, 1 from {pred}) group by {keys}, cand_id),
counts as (select {keys}, sum(t) as nt, sum(p) as np, sum(t * p) as hit from marks group by {keys}),
each as (select i.*, coalesce(nt, 0)::bigint as n_true, coalesce(np, 0)::bigint as n_pred, coalesce(hit, 0)::bigint as tp from {ids} i left join counts using ({keys})),
entity as (select *, case when n_true = 0 and n_pred = 0 then 1.0 when n_true = 0 or tp = 0 then 0.0 else tp / n_pred::double end as precision,
  case when n_true = 0 then 1.0 when tp = 0 then 0.0 else tp / n_true::double end as recall,
  case when n_true = 0 and n_pred = 0 then 1.0 when n_true = 0 or tp = 0 then 0.0 else 1.25 * (tp / n_pred::double) * (tp / n_true::double) / (0.25 * (tp / n_pred::double) + tp / n_true::double) end as f05 from each)"""


_MACRO = "round(coalesce(avg(f05), 0), 6) as macro_f05, round(coalesce(avg(precision), 0), 6) as macro_precision, round(coalesce(avg(recall), 0), 6) as macro_recall, count(*) as n_entities, count(*) filter (where n_true = 0) as n_singletons, round(coalesce(avg(f05) filter (where n_true = 0), 0), 6) as singleton_accuracy, round(coalesce(avg(f05) filter (where n_true > 0), 0), 6) as non_singleton_f05"
_ROUNDED = ["macro_f05", "macro_precision", "macro_recall", "singleton_accuracy", "non_singleton_f05"]


def _rounded(df):
    return df.withColumns({c: F.round(c, 6) for c in _ROUNDED})


def _entities(spark, d):
    s1, _ = _doc_sides(spark, d)
    return metrics.per_entity(s1.select(F.col("entity_id").alias("s1_id")), R.truth_doc(spark, d), assignment.assign(_probs(spark, d), 0.7))


_ENTITY_SQL = f"with {PROBS},\n{_assigned(0.7, 0.05)},\n{S1},\n{TRUTH_DOC},\n{_f05('(select s1_id from s1)', 'truth', 'matched')}"


@query(f"{_ENTITY_SQL} select s1_id, n_true, n_pred, tp, round(precision, 6) as precision, round(recall, 6) as recall, round(f05, 6) as f05 from entity")
def entity_f05(spark, d):
    return _entities(spark, d).withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f05")})


@query(f"{_ENTITY_SQL} select {_MACRO} from entity")
def macro_f05(spark, d):
    return _rounded(metrics.macro(_entities(spark, d)))


def _sweep_sql(grid: list[float]) -> str:
    ts = ", ".join(map(str, grid))
    return f"""with {PROBS},\n{S1},\n{TRUTH_DOC},
thresholds as (select unnest([{ts}])::double as threshold),
tried as (select p.*, threshold, row_number() over (partition by threshold, cand_id order by prob desc, s1_id) as place from probs p, thresholds where prob >= case when n_pairs = 1 then round(threshold + 0.05, 9) else threshold end),
matched as (select * from tried where place = 1),
ids as (select s1_id, country, threshold from s1, thresholds), t2 as (select s1_id, cand_id, threshold from truth, thresholds),
{_f05('ids', 't2', 'matched', 'threshold, s1_id')}"""


@query(f"{_sweep_sql(assignment.grid())} select threshold, {_MACRO} from entity group by threshold")
def sweep_global(spark, d):
    s1, _ = _doc_sides(spark, d)
    return _rounded(assignment.sweep(_probs(spark, d), R.truth_doc(spark, d), s1))


_WIDE = assignment.grid(0.50, 0.94, 0.02)


@query(f"{_sweep_sql(_WIDE)} select country, threshold, {_MACRO} from entity group by country, threshold")
def sweep_country(spark, d):
    return _rounded(_swept_by_country(spark, d))


def _swept_by_country(spark, d):
    s1, _ = _doc_sides(spark, d)
    s1 = s1.withColumn("country", X.country(F.col("country")))
    return assignment.sweep(_probs(spark, d), R.truth_doc(spark, d), s1, _WIDE, by_country=True)


@query(f"""{_sweep_sql(_WIDE)}, by_c as (select country, threshold, avg(f05) as f, count(*) as n from entity group by all),
each_c as (select country, arg_max(threshold, round(f, 9) * 1000 - threshold / 1e6) as threshold, max(f) as f, max(n) as n from by_c group by 1),
whole as (select threshold, sum(f * n) / sum(n) as f from by_c group by 1),
one as (select arg_max(threshold, round(f, 9) * 1000 - threshold / 1e6) as global_threshold, max(f) as gf from whole)
select country, case when round(gf, 9) >= round((select sum(f * n) / sum(n) from each_c), 9) then global_threshold else threshold end as threshold, global_threshold from each_c, one""")
def choose_thresholds(spark, d):
    return assignment.choose_thresholds(_swept_by_country(spark, d))


@query(f"with {BLOCKED},\n{TRUTH_DOC}, hit as (select rank from truth left join ranked using (s1_id, cand_id)), s as (select unnest([5, 10, 30]) as k) select k, count(*) filter (where rank < k) as hits, count(*) as total, round(count(*) filter (where rank < k) / greatest(count(*), 1)::double, 6) as recall from hit, s group by k")
def recall_at_k(spark, d):
    return metrics.recall_at(R.truth_doc(spark, d), _ranked(spark, d), (5, 10, 30)).withColumn("recall", F.round("recall", 6))


_PER_S1 = f"with {O.blocked(O.PART, DROP_CAP, DROP_K, 'drop')}, n as (select entity_id, count(cand_id) as n from parts left join ranked on s1_id = entity_id where entity_id like 'S1-%' group by 1)"


@query(f"{_PER_S1} select round(avg(n), 6) as mean_candidates from n")
def mean_candidates(spark, d):
    s1, _ = R.split_sources(part(spark, d))
    return metrics.candidates_per_entity(s1, _ranked(spark, d, part, DROP_CAP, DROP_K, "drop")).select(F.round("mean_candidates", 6).alias("mean_candidates"))


@query(f"{_PER_S1} select count(*) filter (where n = 0) as zero_candidates from n")
def zero_candidates(spark, d):
    s1, _ = R.split_sources(part(spark, d))
    return metrics.candidates_per_entity(s1, _ranked(spark, d, part, DROP_CAP, DROP_K, "drop")).select("zero_candidates")


# --- labels, samples, splits


_POOL = "pool as (select entity_id from rec where entity_id not like 'S1-%')"


@query(f"""with {O.blocked(O.DOC, V1_CAP, 3, 'truncate')},\n{TRUTH_DOC},\n{_POOL}, n as (select s1_id, count(*) as n from ranked group by 1),
missed as (select * from truth where (s1_id, cand_id) not in (select (s1_id, cand_id) from ranked) and cand_id in (select entity_id from pool))
select s1_id, cand_id, rank::integer as rank from ranked union all select s1_id, cand_id, (coalesce(n, 0) + row_number() over (partition by s1_id order by cand_id) - 1)::integer from missed left join n using (s1_id)""")
def forced_positives(spark, d):
    _, targets = _doc_sides(spark, d)
    return labels.force_positives(_ranked(spark, d, k=3), R.truth_doc(spark, d), targets)


@query(f"""{_pairs_sql(_r(O.jaccard('a.name_char3', 'b.name_char3')) + ' as sim, case when (p.s1_id, p.cand_id) in (select (s1_id, cand_id) from truth) then 1 else 0 end as label').replace('rep0 as (select 1)', TRUTH_DOC)}""".replace("with ", "with rows0 as (with ", 1) + ") select s1_id, cand_id, sim, label from (select *, row_number() over (partition by s1_id, label order by sim desc, cand_id) as place from rows0) where label = 1 or place <= 4")
def hard_negatives(spark, d):
    s1, targets = R.split_sources(represent(doc(spark, d)))
    rows = features.paired(_ranked(spark, d), s1, targets).select("s1_id", "cand_id", F.round(features.built_in()["name_char3_jaccard"], 6).alias("sim"))
    return labels.hard_negatives(labels.label(rows, R.truth_doc(spark, d)), 4, "sim")


@query(f"with {BLOCKED},\n{TRUTH_DOC}, l as (select case when (s1_id, cand_id) in (select (s1_id, cand_id) from truth) then 1 else 0 end as label from ranked), c as (select count(*) filter (where label = 1) as positives, count(*) filter (where label = 0) as negatives from l) select positives, negatives, round(greatest(1.0, negatives / greatest(positives, 1)::double), 6) as scale_pos_weight from c")
def class_weight(spark, d):
    return labels.class_weight(labels.label(_ranked(spark, d), R.truth_doc(spark, d))).withColumn("scale_pos_weight", F.round("scale_pos_weight", 6))


_FLAGGED = f"with rec as ({O.DOC}),\n{TRUTH_DOC}, flagged as (select entity_id, country, count(cand_id) as num_matches, (count(cand_id) = 0)::integer as is_singleton from rec left join truth on s1_id = entity_id where entity_id like 'S1-%' group by 1, 2), placed as (select *, row_number() over (partition by country, is_singleton order by md5(entity_id || ':42'), entity_id) as place, count(*) over (partition by country, is_singleton) as stratum, count(*) over () as total from flagged)"


def _flagged(spark, d):
    s1, _ = _doc_sides(spark, d)
    return sampling.entities_with_flag(s1, R.truth_doc(spark, d))


@query(f"{_FLAGGED} select entity_id, country, num_matches, is_singleton from placed where place <= case when is_singleton = 0 then 30 * 5 // 6 else 30 - 30 * 5 // 6 end")
def strat_sample(spark, d):
    return sampling.stratified_sample(_flagged(spark, d), 30)


@query(f"{_FLAGGED} select entity_id, country, num_matches, is_singleton, stratum, case when place <= round(stratum * least(50 / total::double, 0.2)) then 'val' else 'train' end as split from placed")
def strat_split(spark, d):
    e = _flagged(spark, d)
    n = Window.partitionBy("country", "is_singleton")
    return sampling.stratified_split(e, 50).withColumn("stratum", F.count(F.lit(1)).over(n))


@query(f"with rec as ({O.PART}) select entity_id, (('0x' || substr(md5(entity_id || ':42'), 1, 8))::bigint) % 3 as fold, (('0x' || substr(md5(entity_id || ':42'), 1, 8))::bigint) % 100 < 5 as held_out from rec where entity_id like 'S1-%'")
def group_folds(spark, d):
    s1, _ = R.split_sources(part(spark, d))
    return sampling.grouped_holdout(s1.select("entity_id", sampling.fold("entity_id", 3).alias("fold")), "entity_id")


@query(f"with rec as ({O.PART}) select entity_id, business_name from rec order by md5(entity_id || ':7'), entity_id limit 100")
def sample_ids(spark, d):
    return sampling.sample_n(part(spark, d), 100, seed=7).select("entity_id", "business_name")


@query(f"{_FLAGGED} select country, is_singleton, count(*) as n, round(count(*) / max(total)::double, 6) as share from placed group by 1, 2")
def strata_counts(spark, d):
    return metrics.distribution(_flagged(spark, d), "country", "is_singleton").withColumn("share", F.round("share", 6))


# --- mining


_STOP = L.NAME_STOP + L.LEGAL + L.CORE_STOP_V2
_LINKED = f"""{_norm(O.DOC)}, word_sets as (select entity_id, country, list_distinct(telling) as words, telling[1] as first from (select *, {O.without('name_tokens', _STOP, 3)} as telling from rep)),
heads as (select country, first, min(entity_id) as s1_id from word_sets where entity_id like 'S1-%' and first is not null group by all),
same as (select h.s1_id, b.entity_id as cand_id, h.country, a.words as a, b.words as b from heads h join word_sets b on b.first = h.first and b.country = h.country join word_sets a on a.entity_id = h.s1_id where b.entity_id not like 'S1-%'),
cross_ as (select s1_id, cand_id, country, x, unnest(list_filter(b, lambda t: not list_contains(a, t))) as y from (select *, unnest(list_filter(a, lambda t: not list_contains(b, t))) as x from same)),
near as (select * from cross_ where abs(length(x) - length(y)) <= 2 and levenshtein(x, y) <= 2),
variants as (select country, least(x, y) as x, greatest(x, y) as y, count(*) as n from near group by 1, 2, 3)"""
_RULED = """, df as (select country, term, count(*) as df from (select country, unnest(list_concat(a, b)) as term from same) group by all),
ruled as (select v.country, case when coalesce(dx.df, 0) >= coalesce(dy.df, 0) then y else x end as variant, case when coalesce(dx.df, 0) >= coalesce(dy.df, 0) then x else y end as canonical, n
  from variants v left join df dx on dx.country = v.country and dx.term = x left join df dy on dy.country = v.country and dy.term = y where n >= 1),
rules as (select country, variant, canonical, n from (select *, row_number() over (partition by country, variant order by n desc, canonical) as place from ruled where length(variant) >= 4 and length(canonical) >= 4) where place = 1)"""


def _first_word_links(spark, d):
    """Links for mining: each target and the first S1 record whose name begins with the same telling word, one a target."""
    words = mining.mining_tokens(represent(doc(spark, d)))
    s1, targets = R.split_sources(words.select("entity_id", "country", F.get("words", F.lit(0)).alias("first")))
    heads = s1.groupBy("country", "first").agg(F.min("entity_id").alias("s1_id"))
    links = targets.withColumnRenamed("entity_id", "cand_id").join(heads, ["country", "first"]).select("s1_id", "cand_id")
    return mining.linked_words(links, words)


@query(_LINKED + " select country, x, y, n from variants")
def variant_pairs(spark, d):
    return mining.variant_pairs(_first_word_links(spark, d), sounds=False)


@query(_LINKED + _RULED + " select * from rules")
def canonical_map(spark, d):
    linked = _first_word_links(spark, d)
    return mining.canonical_map(mining.variant_pairs(linked, sounds=False), mining.side_frequency(linked), least_n=1)


@query(_LINKED + f", sound as (select country, least(x, y) as x, greatest(x, y) as y, count(*) as n from near where {O.soundex('x')} = {O.soundex('y')} group by 1, 2, 3) select * from sound")
def variant_pairs_sounding(spark, d):
    return mining.variant_pairs(_first_word_links(spark, d))


@query(_LINKED + _RULED + f",\n{O.parts(O.DOC, rules='rules').replace('rec as (', 'rec2 as (', 1).replace(' from rec)', ' from rec2)')},\n{O.keys_v2()} select entity_id, key_ord, kind, key, weight from keys")
def block_keys_mined(spark, d):
    """Keys of records whose tokens are mapped by mined spellings."""
    linked = _first_word_links(spark, d)
    rules = staging.table(mining.canonical_map(mining.variant_pairs(linked, sounds=False), mining.side_frequency(linked), least_n=1))
    return blocking.keys_v2(blocking.key_parts(doc(spark, d), rules=rules), phonetic=False).select("entity_id", F.col("key_ord").cast("long").alias("key_ord"), "kind", "key", "weight")


# --- sinks and validation


def _lists(spark, d):
    """Match lists with planted faults: doubled rows and ids, foreign prefixes, unknown ids, a missing and an extra row."""
    s1, _ = R.split_sources(part(spark, d))
    k = F.substring("entity_id", 4, 7).cast("long")
    ids = F.concat_ws(",", F.concat(F.lit("S2-"), F.lpad((k + 1).cast("string"), 7, "0")), F.when(k % 5 == 0, F.concat(F.lit("S2-"), F.lpad((k + 1).cast("string"), 7, "0"))), F.when(k % 7 == 0, F.lit("S1-0000001")), F.when(k % 11 == 0, F.lit("S3-unknown")))
    rows = s1.select(F.col("entity_id").alias("source1_entity_id"), ids.alias("matched_entity_ids")).filter(k % 13 != 0)
    return rows.unionByName(rows.filter(F.col("source1_entity_id").endswith("1"))).unionByName(spark.range(1).select(F.lit("S1-extra").alias("source1_entity_id"), F.lit("").alias("matched_entity_ids")))


_ID = "lpad(cast(k + 1 as varchar), 7, '0')"
_LISTS = f"""with rec as ({O.PART}), s1 as (select entity_id, cast(substr(entity_id, 4, 7) as bigint) as k from rec where entity_id like 'S1-%'),
rows_ as (select entity_id as source1_entity_id, concat_ws(',', 'S2-' || {_ID}, case when k % 5 = 0 then 'S2-' || {_ID} end, case when k % 7 = 0 then 'S1-0000001' end, case when k % 11 = 0 then 'S3-unknown' end) as matched_entity_ids from s1 where k % 13 <> 0),
lists as (select * from rows_ union all select * from rows_ where source1_entity_id like '%1' union all select 'S1-extra', '')"""
_IDS = "list_filter([trim(t) for t in string_split(matched_entity_ids, ',')], lambda t: t <> '')"


@query(f"{_LISTS} select source1_entity_id, count(*) as n from lists group by 1 having count(*) > 1")
def dup_rows(spark, d):
    return validation.duplicate_rows(_lists(spark, d))


@query(f"{_LISTS} select source1_entity_id from lists where len({_IDS}) <> len(list_distinct({_IDS}))")
def intra_dups(spark, d):
    return validation.repeated_ids(_lists(spark, d), "matched_entity_ids")


@query(f"{_LISTS}, l as (select source1_entity_id, unnest({_IDS}) as bad_id from lists) select * from l where bad_id not like 'S2-%' and bad_id not like 'S3-%'")
def bad_prefix(spark, d):
    return validation.bad_prefixes(_lists(spark, d), "matched_entity_ids")


@query(f"{_LISTS}, l as (select source1_entity_id, unnest({_IDS}) as unknown_id from lists) select * from l where unknown_id not in (select entity_id from rec where entity_id not like 'S1-%')")
def unknown_ids(spark, d):
    _, targets = R.split_sources(part(spark, d))
    return validation.unknown_ids(_lists(spark, d), "matched_entity_ids", targets)


@query(f"{_LISTS} select entity_id as source1_entity_id from s1 where entity_id not in (select source1_entity_id from lists)")
def missing_rows(spark, d):
    s1, _ = R.split_sources(part(spark, d))
    return validation.missing_rows(_lists(spark, d), s1)


@query(f"{_LISTS} select distinct source1_entity_id from lists where source1_entity_id not in (select entity_id from s1)")
def extra_rows(spark, d):
    s1, _ = R.split_sources(part(spark, d))
    return validation.extra_rows(_lists(spark, d), s1)


@query(f"{_LISTS}, c as (select entity_id as source1_entity_id, 'S2-' || {_ID} as candidate_entity_ids from s1), x as (select source1_entity_id, len([t for t in list_distinct({_IDS}) if not list_contains(string_split(coalesce(candidate_entity_ids, ''), ','), t)]) as n_outside from lists left join c using (source1_entity_id)) select * from x where n_outside > 0")
def subset_warning(spark, d):
    s1, _ = R.split_sources(part(spark, d))
    k = F.substring("entity_id", 4, 7).cast("long")
    c = s1.select(F.col("entity_id").alias("source1_entity_id"), F.concat(F.lit("S2-"), F.lpad((k + 1).cast("string"), 7, "0")).alias("candidate_entity_ids"))
    return validation.not_candidates(_lists(spark, d), c)


@query(f"{_LISTS} select * from lists union all select entity_id, '' from s1 where entity_id not in (select source1_entity_id from lists)")
def backfill_rows(spark, d):
    s1, _ = R.split_sources(part(spark, d))
    return sinks.backfill(_lists(spark, d), s1)


@query(f"with {BLOCKED},\n{S1} select s1.s1_id as source1_entity_id, coalesce(string_agg(cand_id, ',' order by rank), '') as candidate_entity_ids from s1 left join ranked using (s1_id) group by 1")
def candidate_lists(spark, d):
    s1, _ = _doc_sides(spark, d)
    return sinks.candidate_lists(s1, _ranked(spark, d))


@query(f"with {PROBS},\n{_assigned(0.65, 0.05)},\n{S1} select s1.s1_id as source1_entity_id, coalesce(string_agg(cand_id, ',' order by cand_id), '') as matched_entity_ids from s1 left join matched using (s1_id) group by 1")
def link_records(spark, d):
    """The flagship: normalise, block, score, resolve conflicts, list the matches of every S1 record."""
    s1, _ = _doc_sides(spark, d)
    return sinks.match_lists(s1, assignment.assign(_probs(spark, d), 0.65))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_records(spark, sf_dir)


# --- models


def _held(i):
    return sampling.fold(i, 100) < 30


def _labelled(spark, d):
    """Pairs of parts with the basic features, those of equal S1 records as one (ids), and the owner: the S1 record that the
    target belongs to. Truth is the same name, country and postal code."""
    records = part(spark, d)
    owners = R.truth_part(records).select(F.col("cand_id").alias("entity_id"), F.col("s1_id").alias("owner"))
    return staging.table(blocking.featured_v1(*R.split_sources(records), V1_CAP, V1_K, "truncate", owners=owners))


def _split_rows(spark, d):
    """What is trained on, equal rows as one that stands for ``times``; and the held-out rows, one for each pair."""
    rows = _labelled(spark, d)
    own = F.array_contains("kept", F.col("owner"))
    inside = rows.withColumn("kept", F.filter("ids", lambda i: ~_held(i))).withColumn("yes", F.coalesce(own.cast("int"), F.lit(0)))
    each = F.array(F.struct(F.lit(1).alias("label"), F.col("yes").alias("times")), F.struct(F.lit(0).alias("label"), (F.size("kept") - F.col("yes")).alias("times")))
    inside = inside.select("s1_id", "cand_id", *features.BASE_FEATURES, F.inline(each)).filter(F.col("times") > 0)
    outside = rows.withColumn("s1_id", F.explode(F.filter("ids", _held))).withColumn("label", F.coalesce((F.col("s1_id") == F.col("owner")).cast("int"), F.lit(0))).drop("ids", "owner")
    return inside, outside


_SMALL = "small"


@query()
def gbt_scores(spark, d):
    inside, outside = _split_rows(spark, d)
    p = models.Preset(8, 4, 0.2)
    return models.score(models.train(inside, features.BASE_FEATURES, p), outside).select("s1_id", "cand_id", "label", F.round("prob", 6).alias("prob"))


@query()
def stacked_scores(spark, d):
    inside, outside = _split_rows(spark, d)
    return models.score(models.train(inside, features.BASE_FEATURES, models.PRESETS[_SMALL]), outside).select("s1_id", "cand_id", "label", F.round("prob", 6).alias("prob"))


@query()
def auc(spark, d):
    return spark.createDataFrame([(models.auc(gbt_scores(spark, d)),)], "auc double")


@query()
def importance(spark, d):
    inside, _ = _split_rows(spark, d)
    return spark.createDataFrame(models.importance(models.train(inside, features.BASE_FEATURES, models.Preset(8, 4, 0.2))), "feature string, importance double")
