"""Retrieval by blocks of queries: the pairs of a query are made, scored and ranked where they arise and never shuffled.

A key's list of targets goes once to each block of queries that has the key, as numbers, and each target in these lists
once to the block; a query then adds up its lists over the block's targets. Equal queries are asked once. What travels
grows with lists x blocks, not with the pairs, of which a query has as many as its keys' lists have entries.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import staging
from .features import OF_ADDRESSES, OF_NAMES, address_shape, address_values, name_shape, name_values

# Queries a block; entries of a row that carries a part of a list; rows that carry a block's targets (a row on
# its way to Python costs far more than an entry); rows of equal queries that are folded apart, so that many copies spread;
# pairs a batch that goes back.
BLOCK, PIECE, PACKS, APART, BATCH = 8192, 1000, 512, 4, 20_000
TARGET, LIST, QUERY = 0, 1, 2
PAIR = "s1_id string, cand_id string, score double, first_ord int, boost double, rank int, best_key double"
COSINE = "s1_id string, cand_id string, cosine double"
RERANKED = "s1_id string, cand_id string, score double, first_ord int, boost double, best_key double, cosine double, fuzzy_name double, fuzzy_addr double, key_share double, final double, rank int"
_EMPTY = {"id": "string", "no": "bigint", "key": "string", "n_key": "bigint", "nos": "array<bigint>", "postal": "string", "street_no": "string", "print_addr": "array<string>", "words": "array<string>", "ws": "array<double>", "norm": "double", "name": "string", "addr": "string", "ids": "array<string>", "keys": "array<struct<ord:int,key:string,weight:double,n:bigint>>"}
_TARGET = ["id", "no", "postal", "street_no", "print_addr", "words", "ws", "norm", "name", "addr"]
_SHOWN = {"rep": "struct<name:string,acronym:string,addr:string>", "owner": "string"}


def retrieve(q: DataFrame, t: DataFrame, keys: Callable[[DataFrame], DataFrame], posting: Callable[[DataFrame], DataFrame], run: Callable, schema: str, terms: Callable[[DataFrame], DataFrame] | None = None, apart: int = APART, told: DataFrame | None = None) -> DataFrame:
    """``run`` (see ``_blocks``) over the blocks of queries. ``q`` and ``t`` are key parts; ``keys`` gives their keys, ``posting``
    the targets' lists as they are used; ``terms`` the weighted terms of parts, for which the texts go along too;
    ``told`` (entity_id, ...) what equal queries share besides their keys and facts. Parts with rep bring it along, and owner
    of targets, for ``Block.features``; ``told`` then has the texts that rep is made of."""
    c = F.col
    # Targets are numbered in the order of their ids, in which ties are broken.
    ids = t.select("entity_id").distinct().orderBy("entity_id").withColumn("no", F.monotonically_increasing_id())
    t = staging.table(t.join(ids, "entity_id"))
    lists = posting(keys(t.withColumn("entity_id", c("no")))).withColumn("piece", F.pmod(F.xxhash64("cand_id"), F.ceil(c("n_key") / PIECE)))
    lists = lists.groupBy("key", "piece").agg(F.max("n_key").alias("n_key"), F.collect_list("cand_id").alias("nos"))

    sizes = F.broadcast(t.groupBy("country").agg(F.count(F.lit(1)).alias("n")))  # a row for each country
    facts = ["postal", "street_no", "print_addr"]
    asked = keys(q).join(sizes, "country").groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct(c("key_ord").alias("ord"), "key", "weight", "n"))).alias("keys"))
    texts = lambda p: p.select("entity_id", c("clean").alias("name"), F.array_join("addr_tokens", " ").alias("addr")).join(terms(p).select("entity_id", c("terms.term").alias("words"), c("terms.w").alias("ws"), "norm"), "entity_id", "left")
    shown = _SHOWN if "rep" in q.columns else {}
    own = q.select("entity_id", "country", *facts, *[x for x in shown if x in q.columns])
    if terms:
        own = own.join(texts(q).select("entity_id", "name", "addr", "words", "ws", "norm"), "entity_id")
        t = t.join(texts(t).select("entity_id", "name", "addr", "words", "ws", "norm"), "entity_id")
        facts = [*facts, "name", "addr", "words", "ws", "norm"]
    more = [x for x in told.columns if x != "entity_id"] if told else []
    own = own.join(told, "entity_id") if told else own
    derived = ("words", "ws", "norm", "rep")
    # The terms of equal names and addresses are equal, but for their order and so their norms' last digits.
    same = ["country", "keys", *more, *[f for f in facts if f not in derived], F.pmod(F.xxhash64("entity_id"), F.lit(apart)).alias("apart")]
    folded = asked.join(own, "entity_id").groupBy(*same).agg(F.sort_array(F.collect_list("entity_id")).alias("ids"), *[F.first(f).alias(f) for f in own.columns if f in derived])
    counts = F.broadcast(q.groupBy("country").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks")))  # a row for each country
    block = F.concat_ws("/", "country", F.pmod(F.xxhash64(c("street_no"), c("postal"), c("apart")), c("blocks")).cast("string"))
    folded = staging.table(folded.join(counts, "country").withColumn("block", block).drop("country", "blocks", "apart", *more))
    shipped = staging.table(folded.select("block", F.explode("keys.key").alias("key")).distinct().join(lists, "key").select("block", "key", "n_key", "nos"))
    touched = shipped.select("block", F.explode("nos").alias("no")).distinct().join(t.select("no", c("entity_id").alias("id"), *facts, *shown), "no")
    typed = lambda df, kinds: [c(x) if x in df.columns else F.lit(None).cast(kind).alias(x) for x, kind in kinds.items()]
    each = {x: _EMPTY[x] for x in _TARGET} | shown
    n = max(1, folded.select("block").distinct().count())
    dealt = touched.repartition(max(2 * n, 2), "block").withColumn("pack", F.pmod(F.xxhash64("no"), F.lit(PACKS)))
    packed = dealt.groupBy("block", "pack").agg(F.collect_list(F.struct(*typed(touched, each))).alias("targets"))
    carried = _EMPTY | shown | {"targets": f"array<struct<{','.join(f'{x}:{kind}' for x, kind in each.items())}>>"}

    def rows(df: DataFrame, what: int) -> DataFrame:
        return df.select("block", F.lit(what).alias("what"), *typed(df, carried))

    every = rows(packed, TARGET).unionByName(rows(shipped, LIST)).unionByName(rows(folded, QUERY))
    return every.repartition(max(2 * n, 2), "block").sortWithinPartitions("block", "what").mapInArrow(_blocks(run, schema), schema)


def _blocks(run: Callable, schema: str) -> Callable:
    """For mapInArrow, over rows by block: its targets, its lists, its queries. ``run`` gets a block and a query and gives its
    columns but s1_id, as arrays, with cand_id as places of the block's targets. With ids, equal queries stay one."""
    names = [x.strip().split(" ")[0] for x in schema.split(", ")]

    def each(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        block, waiting, made = None, [], 0

        def flushed():
            who = pa.array([i for ids, _ in waiting for i in ids], pa.string())
            columns: dict = {}
            copies = [[found] * len(ids) for ids, found in waiting] if names[0] != "ids" else [[found] for _, found in waiting]
            flat = [x for xs in copies for x in xs]
            sizes = [len(x["cand_id"]) for x in flat]
            if names[0] == "ids":
                columns["ids"] = pa.array([ids for ids, _ in waiting], pa.list_(pa.string())).take(pa.array(np.repeat(np.arange(len(flat)), sizes)))
                columns["s1_id"] = pa.array([ids[0] for ids, _ in waiting], pa.string()).take(pa.array(np.repeat(np.arange(len(flat)), sizes)))
            else:
                columns["s1_id"] = who.take(pa.array(np.repeat(np.arange(len(flat)), sizes)))
            if "values" in flat[0]:
                columns |= dict(zip(names[-flat[0]["values"].shape[1] :], map(pa.array, np.concatenate([f["values"] for f in flat]).T.copy())))
                columns["owner"] = block.owner.take(pa.array(np.concatenate([f["cand_id"] for f in flat])))
            for x in names:
                if x not in columns:
                    values = np.concatenate([f[x] for f in flat])
                    columns[x] = block.ids.take(pa.array(values)) if x == "cand_id" else pa.array(values.astype(np.int32) if x in ("rank", "first_ord") else values)
            return pa.RecordBatch.from_arrays([columns[x] for x in names], names)

        for batch in batches:
            at = 0
            tags, whats = batch.column("block").to_pylist(), batch.column("what").to_pylist()
            while at < len(tags):
                end = at
                while end < len(tags) and tags[end] == tags[at] and whats[end] == whats[at]:
                    end += 1
                part = batch.slice(at, end - at)
                if block is None or block.tag != tags[at]:
                    if waiting:
                        yield flushed()
                        waiting, made = [], 0
                    block = Block(tags[at])
                if whats[at] != QUERY:
                    block.add(whats[at], part)
                else:
                    block.ready()
                    for row in part.select(["ids", "keys", "postal", "street_no", "print_addr", "words", "ws", "norm", "name", "addr", *[x for x in part.schema.names if x == "rep"]]).to_pylist():
                        found = run(block, row)
                        if not len(found["cand_id"]):
                            continue
                        ids = row["ids"]
                        step = max(1, BATCH // len(found["cand_id"])) if names[0] != "ids" else len(ids)
                        for i in range(0, len(ids), step):
                            waiting.append((ids[i : i + step], found))
                            made += len(found["cand_id"]) * (min(step, len(ids) - i) if names[0] != "ids" else 1)
                            if made >= BATCH:
                                yield flushed()
                                waiting, made = [], 0
                at = end
        if waiting:
            yield flushed()

    return each


class Block:
    """The targets and lists of a block of queries, by places in the order of the targets' numbers."""

    def __init__(self, tag: str):
        self.tag, self.targets, self.pieces, self.lists = tag, [], {}, None

    def add(self, what: int, part) -> None:
        import pyarrow as pa

        if what == TARGET:
            self.targets.append(pa.RecordBatch.from_struct_array(part.column("targets").flatten()))
            return
        nos = part.column("nos")
        values, ends = nos.flatten().to_numpy(zero_copy_only=False), nos.value_lengths().to_numpy(zero_copy_only=False).cumsum()
        start = 0
        for key, n, end in zip(part.column("key").to_pylist(), part.column("n_key").to_pylist(), ends):
            self.pieces.setdefault(key, (n, []))[1].append(values[start:end].copy())
            start = end

    def ready(self) -> None:
        if self.lists is not None:
            return
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        table = pa.Table.from_batches(self.targets).sort_by("no").combine_chunks()
        self.targets = []
        nos = table.column("no").to_numpy()
        column = lambda x: (lambda y: y.combine_chunks() if isinstance(y, pa.ChunkedArray) else y)(table.column(x))
        self.n, self.ids = len(nos), column("id")
        self.numbers, self.number = np.unique(nos, return_inverse=True)  # an id of several rows has one number
        self.single = len(self.numbers) == self.n
        self.lists = {}
        for key, (n, pieces) in self.pieces.items():
            places, often = np.unique(np.searchsorted(self.numbers, np.concatenate(pieces)), return_counts=True)
            self.lists[key] = n, places, None if often.max() == 1 else often.astype(float)
        self.pieces = {}
        self.codes: dict[str, dict] = {}
        for x in ("postal", "street_no", "name", "addr"):
            coded = column(x).dictionary_encode()
            setattr(self, x, pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False))
            self.codes[x] = {v: i for i, v in enumerate(coded.dictionary.to_pylist())}
        self.texts = {x: list(self.codes[x]) for x in ("name", "addr")}
        self.prints, self.codes["print"] = self._lists(column("print_addr"))
        terms, self.codes["word"] = self._lists(column("words"))
        self.starts, self.ends, self.words = terms
        self.ws = column("ws").flatten().to_numpy(zero_copy_only=False)
        self.norm = pc.fill_null(column("norm"), 0.0).to_numpy(zero_copy_only=False)
        starts, ends, values = self.prints
        width = int((ends - starts).max()) if self.n else 0
        self.prints = np.full((self.n, width), len(self.codes["print"]), np.int64)  # the last code is no token's
        for i in range(width):
            has = starts + i < ends
            self.prints[has, i] = values[starts[has] + i]
        self.sum, self.first = np.zeros(len(self.numbers)), np.zeros(len(self.numbers), np.int32)
        self.wanted, self.weight = np.zeros(len(self.codes["print"]) + 1, np.int8), np.zeros(len(self.codes["word"]) + 1)
        self.known: dict = {}
        if "rep" in table.column_names:
            self.owner, rep = column("owner"), column("rep")
            names, addresses = (rep.field(x).dictionary_encode() for x in ("name", "addr"))
            short = dict(zip(names.indices.to_pylist(), rep.field("acronym").to_pylist()))  # a name has one
            shapes = [name_shape(x, short[i]) for i, x in enumerate(names.dictionary.to_pylist())], list(map(address_shape, addresses.dictionary.to_pylist()))
            self.shown = [(x.indices.to_numpy(zero_copy_only=False), y) for x, y in zip((names, addresses), shapes)]
            self.is_s2 = pc.starts_with(self.ids, "S2-").to_numpy(zero_copy_only=False)

    @staticmethod
    def _lists(x):
        import numpy as np
        import pyarrow.compute as pc

        sizes = pc.fill_null(x.value_lengths(), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = sizes.cumsum()
        coded = x.flatten().dictionary_encode()
        return (ends - sizes, ends, coded.indices.to_numpy(zero_copy_only=False)), {v: i for i, v in enumerate(coded.dictionary.to_pylist())}

    def hits(self, keys: list[dict], idf: bool):
        """Rows of targets that share a key, their sums of weights and first keys; the largest weight of a key."""
        import numpy as np

        best, used = 0.0, []
        for k in reversed(keys):
            found = self.lists.get(k["key"])
            if found:
                n_key, places, often = found
                w = k["weight"] * np.log1p(k["n"] / n_key) if idf else k["weight"]
                self.sum[places] += w if often is None else w * often
                self.first[places] = k["ord"]  # keys go backwards: the first stays
                best = max(best, w)
                used.append(places)
        there = np.flatnonzero(self.sum)
        rows = there if self.single else np.flatnonzero(self.sum[self.number])
        at = rows if self.single else self.number[rows]
        out = rows, self.sum[at], self.first[at], best
        self.sum[there] = 0.0
        return out

    def boost(self, row: dict, rows, worth: tuple):
        """What equal address facts are worth; shared tokens count as often as the target has them."""
        import numpy as np

        postal, street, token, most = worth
        out = np.zeros(len(rows))
        for x, plus in (("postal", postal), ("street_no", street)):
            code = self.codes[x].get(row[x]) if row[x] is not None else None
            if code is not None:
                out += plus * (getattr(self, x)[rows] == code)
        mine = [self.codes["print"][w] for w in row["print_addr"] or [] if w in self.codes["print"]]
        if mine and len(rows):
            self.wanted[mine] = 1
            out += token * np.minimum(self.wanted[self.prints[rows]].sum(axis=1), most)
            self.wanted[mine] = 0
        return out

    def cosine(self, row: dict, rows):
        """0 where no term is shared."""
        import numpy as np

        out = np.zeros(len(rows))
        mine = [(self.codes["word"][w], x) for w, x in zip(row["words"] or [], row["ws"] or []) if w in self.codes["word"]]
        if not mine or not row["norm"] or not len(rows):
            return out
        codes = [i for i, _ in mine]
        self.weight[codes] = [x for _, x in mine]
        sizes = self.ends[rows] - self.starts[rows]
        place = np.repeat(self.starts[rows] - (sizes.cumsum() - sizes), sizes) + np.arange(sizes.sum())
        dot = np.bincount(np.repeat(np.arange(len(rows)), sizes), self.weight[self.words[place]] * self.ws[place], len(rows))
        self.weight[codes] = 0.0
        norm = row["norm"] * self.norm[rows]
        np.divide(dot, norm, out=out, where=norm > 0)
        return out

    def token_set(self, field: str, text: str | None, rows):
        """The kernel over the distinct texts of ``rows``."""
        import numpy as np

        from ..functions.similarity import token_set

        codes, back = np.unique(getattr(self, field)[rows], return_inverse=True)
        if len(self.known) > 500_000:
            self.known.clear()
        known, texts = self.known, self.texts[field]
        values = []
        for i in codes.tolist():
            v = known.get((field, text, i))
            if v is None:
                v = known[field, text, i] = token_set(text or "", texts[i] or "" if i >= 0 else "")
            values.append(v)
        return np.array(values, dtype=float)[back]

    def features(self, row: dict, rows, score):
        """A row of features for each of ``rows``, in the order of ``IN_BLOCKS``; texts are compared once in the block."""
        import numpy as np

        mine = name_shape(row["rep"]["name"], row["rep"]["acronym"]), address_shape(row["rep"]["addr"])
        columns = []
        for kind, ((coded, shapes), a, of, width) in enumerate(zip(self.shown, mine, (name_values, address_values), (len(OF_NAMES), len(OF_ADDRESSES)))):
            codes, back = np.unique(coded[rows], return_inverse=True)
            if len(self.known) > 200_000:
                self.known.clear()
            known, values = self.known, []
            for i in codes.tolist():
                v = known.get((kind, a[0], i))
                if v is None:
                    v = known[kind, a[0], i] = of(a, shapes[i])
                values.append(v)
            columns.append(np.array(values, dtype=float).reshape(-1, width)[back])
        for x in ("postal", "street_no"):
            there = (getattr(self, x)[rows] >= 0) & (row[x] is not None)
            same = there & (getattr(self, x)[rows] == self.codes[x].get(row[x], -2))
            columns += [np.where(same, 1.0, -1.0) * there, there, there & ~same]
        return np.column_stack([*columns, self.is_s2[rows], np.arange(len(rows)), score]).astype(float)


def first_places(k: int, score, *ties):
    """Places of the ``k`` largest scores, ties to the smaller of ``ties``, in order; exact however many are equal."""
    import numpy as np

    some = np.arange(len(score))
    if len(score) > k:
        some = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    return some[np.lexsort([*[x[some] for x in reversed(ties)], -score[some]])][:k]
