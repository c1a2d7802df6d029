"""python -m sparktide prepare|train|validate|nested|baselines: the pipeline from the command line."""

from __future__ import annotations

import argparse
from dataclasses import fields

from pyspark.sql import SparkSession

from sparktide.config import EngineConfig, Paths
from sparktide.operators.baselines import Sizes
from sparktide.plans import pipeline
from sparktide.sources import artifacts


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sparktide")
    p.add_argument("step", choices=["prepare", "train", "validate", "nested", "baselines"])
    p.add_argument("--recordings", help="folder of <subject>/*.edf and annotation lists")
    p.add_argument("--out", help="folder of windows, manifest and results")
    p.add_argument("--paths", help="file of lines 'name: folder' that stand for --recordings and --out where these aren't given")
    p.add_argument("--approximate-split", action="store_true", help="split on rates from headers and annotations")
    p.add_argument("--inner-folds", type=int, default=3)
    p.add_argument("--methods", nargs="+", default=["MultiRocket", "Arsenal", "STSForest", "CIF", "DrCIF", "Shapelet", "TimeCNN", "TimeRNN"], help="baselines to compare")
    for f in fields(Sizes):
        p.add_argument("--baseline-" + f.name.replace("_", "-"), type=type(f.default), default=f.default)
    p.add_argument("--balance", choices=["none", "undersample", "oversample"], default="none")
    p.add_argument("--folds", type=int, default=3)
    p.add_argument("--no-smoothing", action="store_true")
    for f in fields(EngineConfig):
        p.add_argument("--" + f.name.replace("_", "-"), type=type(f.default), default=f.default)
    return p


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    config = EngineConfig(**{f.name: getattr(args, f.name) for f in fields(EngineConfig)})
    spark = SparkSession.builder.getOrCreate()
    if args.paths:
        paths = Paths.from_text("\n".join(r.value for r in spark.read.text(args.paths, wholetext=True).collect()))
        args.recordings, args.out = args.recordings or paths.raw_data, args.out or paths.artifacts
    if not args.out or (args.step == "prepare" and not args.recordings):
        raise SystemExit("--out and, to prepare, --recordings are needed")
    if args.step == "prepare":
        pipeline.prepare(spark, args.recordings, args.out, config, approximate=args.approximate_split)
        return
    if args.step == "nested":
        folds, summary = pipeline.nested_validate(artifacts.read_windows(spark, f"{args.out}/windows"), config, None, args.folds, args.inner_folds)
        artifacts.write_json(folds, f"{args.out}/nested_folds")
        artifacts.write_json(summary, f"{args.out}/nested_summary")
        return
    if args.step == "baselines":
        sizes = Sizes(**{f.name: getattr(args, f"baseline_{f.name}") for f in fields(Sizes)})
        artifacts.write_json(pipeline.compare_baselines(artifacts.read_windows(spark, f"{args.out}/windows"), args.methods, sizes, config.seed), f"{args.out}/baselines")
        return
    rows = pipeline.features(artifacts.read_windows(spark, f"{args.out}/windows"), config).cache()
    if args.step == "train":
        model = pipeline.fit(pipeline.balanced(rows.where("split = 'train'"), args.balance, config.seed), config)
        model.table(spark).write.mode("overwrite").parquet(f"{args.out}/model")
        test = rows.where("split = 'test'")
        artifacts.write_json(pipeline.evaluate(model, test, config, not args.no_smoothing), f"{args.out}/evaluation")
        pipeline.report(model, test, spark.read.json(f"{args.out}/evaluation"), f"{args.out}/figures")
    else:
        folds, summary = pipeline.cross_validate(rows, args.folds, config)
        artifacts.write_json(folds, f"{args.out}/folds")
        artifacts.write_json(summary, f"{args.out}/summary")


if __name__ == "__main__":
    main()
