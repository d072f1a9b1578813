"""python -m kinweave.cli split|mine|pairs|train|predict|all|evaluate|validate|package"""

from __future__ import annotations

import argparse
import json
import shutil
import sys
import zipfile
from pathlib import Path

from .operators import models, validation
from .plans import linkage
from .session import session
from .sources import records as R
from .sources import sinks


def _tables(spark, folder: str, prefix: str):
    s1 = R.scan_tsv(spark, f"{folder}/{prefix}_source1.tsv")
    targets = R.union_targets(*(R.scan_tsv(spark, f"{folder}/{prefix}_source{i}.tsv") for i in (2, 3)))
    return s1, targets


def _truth(spark, folder: str):
    return R.long_pairs(R.scan_tsv(spark, f"{folder}/train_ground_truth.tsv", R.TRUTH))


def _validate(spark, out: str, test: str, check_ids: bool) -> int:
    s1, targets = _tables(spark, test, "test")
    findings, lists = [], {}
    for name, schema in (("matching_results", R.TRUTH), ("candidate_pairs", R.CANDIDATES)):
        path = f"{out}/{name}.tsv"
        problem = validation.header_problem(spark, path, tuple(schema.fieldNames()))
        if problem:
            print(f"FATAL {name}: {problem}")
            return 1
        lists[name] = R.scan_tsv(spark, path, schema)
        findings.append(validation.finding("row without tab", "error", validation.rows_without_tab(spark.read.text(path)), "value"))
    known = targets if check_ids else None
    findings += validation.report(spark, lists["candidate_pairs"], "candidate_entity_ids", s1, known)
    findings += validation.report(spark, lists["matching_results"], "matched_entity_ids", s1, known, lists["candidate_pairs"])
    for f in findings:
        if f.total:
            print(f"{f.severity.upper()} {f.rule}: {f.total}, for example {', '.join(f.examples)}")
    return validation.exit_code([f for f in findings if f.total])


def package(team: str, out: str, to: str, documents: str | None = None, code: str | None = None) -> str:
    """The two result tables, a document and the sources of a folder in one zip."""
    path = Path(to) / f"{team}_submission.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name in ("matching_results.tsv", "candidate_pairs.tsv"):
            source = Path(out) / name
            files = sorted(source.glob("part-*")) if source.is_dir() else [source]
            with z.open(f"output/{name}", "w") as f:
                for i, p in enumerate(files):
                    with p.open("rb") as part:
                        if i:
                            part.readline()  # one header
                        shutil.copyfileobj(part, f)
        if documents:
            z.write(documents, Path(documents).name)
        if code:
            top = Path(code)
            for p in sorted(top.rglob("*")):
                if p.suffix in (".py", ".txt", ".md") and not p.name.startswith("."):
                    z.write(p, f"code/{top.name}/{p.relative_to(top)}")
    return str(path)


def main(argv: list[str] | None = None) -> int:
    a = argparse.ArgumentParser(prog="kinweave", description=__doc__)
    a.add_argument("mode", choices=["split", "mine", "pairs", "train", "predict", "all", "evaluate", "validate", "package"])
    a.add_argument("--train", default="train")
    a.add_argument("--test", default="test")
    a.add_argument("--out", default="output")
    a.add_argument("--model", default="model")
    a.add_argument("--preset", default="stack_v6", choices=list(models.PRESETS))
    a.add_argument("--val-size", type=int, default=50_000)
    a.add_argument("--threshold", type=float)
    a.add_argument("--generation", type=int, default=2, choices=[1, 2])
    a.add_argument("--rules", help="mined spellings, as the mode mine writes them")
    a.add_argument("--pairs", help="shards of the mode pairs, to train on")
    a.add_argument("--entities", type=int, default=500_000, help="S1 records of the mode pairs")
    a.add_argument("--per-country", type=int, default=3000, help="S1 records that the mode evaluate samples of each country")
    a.add_argument("--score", action="store_true", help="evaluate: score with the model too")
    a.add_argument("--check-ids", action="store_true")
    a.add_argument("--skip-validation", action="store_true")
    a.add_argument("--team", default="team")
    a.add_argument("--doc", help="package: a document to put in")
    a.add_argument("--code", help="package: a folder of sources to put in")
    x = a.parse_args(argv)
    spark = session()
    how = linkage.Candidates(generation=x.generation, rules=R.scan_rules(spark, x.rules) if x.rules else None)
    if x.mode == "package":
        if not x.skip_validation and (code := _validate(spark, x.out, x.test, x.check_ids)):
            print("not packaged: the results are not valid")
            return code
        print(package(x.team, x.out, ".", x.doc, x.code))
        return 0
    if x.mode in ("split", "all"):
        s1, _ = _tables(spark, x.train, "train")
        sinks.write_split(linkage.split(s1, _truth(spark, x.train), x.val_size), f"{x.out}/split")
    if x.mode == "mine":
        s1, targets = _tables(spark, x.train, "train")
        linkage.mine_variants(s1, targets, _truth(spark, x.train)).write.mode("overwrite").json(f"{x.out}/variants")
    if x.mode == "pairs":
        s1, targets = _tables(spark, x.train, "train")
        made = linkage.Candidates(generation=x.generation, k=60, overgenerate=120, caps={"exact": 20_000, "key": 1500}, rules=how.rules)
        told = linkage.generate_pairs(s1, targets, _truth(spark, x.train), f"{x.out}/pairs", made, x.entities, x.per_country)
        sinks.write_json(spark, told, f"{x.out}/pairs_meta.json")
        print(json.dumps(told))
    if x.mode in ("train", "all"):
        s1, targets = _tables(spark, x.train, "train")
        matcher, result = linkage.train(s1, targets, _truth(spark, x.train), x.val_size, x.preset, how, shards=R.scan_shards(spark, x.pairs) if x.pairs else None)
        matcher.save(x.model)
        sinks.write_json(spark, result, f"{x.out}/metrics.json")
        print(json.dumps(result))
    if x.mode in ("predict", "all"):
        s1, targets = _tables(spark, x.test, "test")
        candidates, matches = linkage.predict(s1, targets, models.Matcher.load(x.model), how, x.threshold)
        sinks.write_tsv(candidates, f"{x.out}/candidate_pairs.tsv")
        sinks.write_tsv(matches, f"{x.out}/matching_results.tsv")
    if x.mode == "evaluate":
        s1, targets = _tables(spark, x.train, "train")
        result = linkage.harness(s1, targets, _truth(spark, x.train), how, models.Matcher.load(x.model) if x.score else None, x.per_country)
        sinks.write_json(spark, result, f"{x.out}/evaluation.json")
        print(json.dumps(result))
    return _validate(spark, x.out, x.test, x.check_ids) if x.mode in ("validate", "all") else 0


if __name__ == "__main__":
    sys.exit(main())
