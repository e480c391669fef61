"""Command line: ``python -m seqloom [options] -- samples prefix``."""

from __future__ import annotations

import argparse
import dataclasses
import logging

from pyspark.sql import SparkSession

from seqloom.operators.reduce import UmapOptions
from seqloom.plans.analysis import run
from seqloom.plans.options import Options


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="seqloom", description="K-mer count matrices and their statistics on Spark.")
    p.add_argument("samples", help="file with a sample a line: name and files")
    p.add_argument("prefix", help="beginning of the output names")
    p.add_argument("-k", type=int, default=25)
    p.add_argument("-f", dest="fmt", choices=["fq", "fa", "mf"], default="fq")
    p.add_argument("-b", dest="canonical", action="store_false", help="no canonical form")
    for name, kind in (("ci", int), ("cx", int), ("cs", int), ("thr", int), ("thr-rat", float), ("leave", int), ("cv-seed", int), ("max-corrected-pval", float), ("on", int)):
        key = {"on": "bins"}.get(name, name.replace("-", "_"))
        p.add_argument(f"--{name}", dest=key, type=kind, default=getattr(Options, key))
    p.add_argument("--flt")
    p.add_argument("--tot-cnt", dest="totals", action="store_true")
    p.add_argument("--reuse-db", dest="reuse", action="store_true")
    p.add_argument("-o", dest="outputs", choices=["fa", "matrix"], nargs="+", default=())
    p.add_argument("-n", dest="normalize", choices=["deseq", "freq", "q"])
    p.add_argument("--save-n", dest="save_normalized", action="store_true")
    p.add_argument("--cor", choices=["kendall", "pearson", "spearman"], nargs="+", default=())
    p.add_argument("-p", dest="phenotype")
    p.add_argument("--diff", choices=["anova", "dids", "snr", "ttest", "wrs"], nargs="+", default=())
    p.add_argument("-c", dest="classes")
    p.add_argument("--pval-corr", choices=["b", "bh", "by", "hb"])
    p.add_argument("--dids-mode", choices=["quadratic", "sqrt", "tanh"], default="sqrt")
    p.add_argument("--n-top", type=int)
    p.add_argument("--dimensions", type=int)
    p.add_argument("--pca-mode", choices=["covariance", "svd"], default="svd")
    for flag in ("cv", "entropy", "umap", "pca", "learn-deseq", "learn-q"):
        p.add_argument(f"--{flag}", action="store_true")
    p.add_argument("--generate-snr-for-unnormalized-data", dest="snr_raw", action="store_true")
    for f in dataclasses.fields(UmapOptions):
        p.add_argument(f"--umap-{f.name.replace('_', '-')}", dest=f"umap_{f.name}", type=type(f.default), default=f.default)
    p.add_argument("-v", action="count", default=0)
    return p


def main(argv: list[str] | None = None) -> None:
    args = vars(parser().parse_args(argv))
    console = logging.StreamHandler()
    console.setLevel([logging.WARNING, logging.INFO, logging.DEBUG][min(2, args.pop("v"))])
    logging.getLogger("seqloom").addHandler(console)
    samples, prefix = args.pop("samples"), args.pop("prefix")
    umap = UmapOptions(**{f.name: args.pop(f"umap_{f.name}") for f in dataclasses.fields(UmapOptions)})
    spark = SparkSession.builder.appName("seqloom").getOrCreate()
    run(spark, Options(umap_options=umap, **args), samples, prefix)


if __name__ == "__main__":
    main()
