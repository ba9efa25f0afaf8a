"""Command line: ``python -m presencekit.cli COMMAND``."""

from __future__ import annotations

import argparse
import logging
import sys

from . import __version__
from .errors import PanelError
from .plans import commands
from .session import session
from .sources import lists, tables


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="presencekit")
    p.add_argument("-V", "--version", action="version", version=__version__)
    p.add_argument("--profile", default="laptop")
    p.add_argument("--threads", type=int)
    p.add_argument("-v", "--verbose", action="count", default=0, help="log steps; twice: details")
    sub = p.add_subparsers(dest="command")

    def add(name: str, **options):
        s = sub.add_parser(name)
        for flag, kw in options.items():
            s.add_argument("--" + flag.replace("_", "-"), **kw)

    need, whole = {"required": True}, {"type": int, "required": True}
    of = {"matrix": {"help": "a panel, or a matrix file"}, "matrix_list": {"help": "a file that lists the stripes; wins over --matrix"}}
    add("count", input=need, k=whole, ci={"type": int, "default": 1}, out=need, strand={"default": "forward", "choices": ["forward", "canonical"]})
    add("import-kmers", input=need, k=whole, out=need)
    add("build", list=need, k=whole, out=need)
    add("build-master", list=need, k=whole, out=need)
    add("create-stripe", master=need, out=need, num_accessions=whole, stripe_index=whole)
    add("fill", stripe=need, list=need, k=whole, out=need)
    add("compress", stripes={"required": True, "nargs": "+"}, list=need, k=whole, out=need)
    add("import-matrix", **of, list=need, out=need)
    add("pop", **of, list=need, out=need, npc={"type": int, "default": 0}, max_samples={"type": int, "default": 0}, seed={"type": int, "default": 42})
    add("gwas", **of, list=need, pheno=need, pop=need, k={"type": int}, npc={"type": int, "default": 2}, top_n={"type": int, "default": 1000}, all={"action": "store_true"}, details={"action": "store_true"})
    add("gene", **of, list=need, gene=need, k={"type": int})
    add("validate", **of, list=need, k={"type": int})
    return p


def main(argv: list[str] | None = None) -> int:
    p = parser()
    a = p.parse_args(argv)
    if not a.command:
        p.print_help()
        return 0
    logging.basicConfig(level=(logging.WARNING, logging.INFO, logging.DEBUG)[min(a.verbose, 2)], format="%(asctime)s %(levelname)s %(message)s")
    logging.getLogger("py4j").setLevel(logging.WARNING)
    try:
        spark = session(a.profile, a.threads)
        if a.command == "count":
            commands.count(spark, [a.input], a.k, a.out, a.ci, a.strand)
        elif a.command == "import-kmers":
            commands.import_kmers(spark, a.input, a.k, a.out)
        elif a.command == "build":
            commands.build(spark, a.list, a.k, a.out)
        elif a.command == "build-master":
            commands.build_master(spark, a.list, a.k, a.out)
        elif a.command == "create-stripe":
            commands.create_stripe(spark, a.master, a.out, a.num_accessions, a.stripe_index)
        elif a.command == "fill":
            commands.fill(spark, a.stripe, commands.presence_of(spark, a.list, a.k)[1], a.out)
        elif a.command == "compress":
            commands.compress(spark, a.stripes, a.k, len(lists.resolve_list(a.list)), a.out)
        elif a.command == "import-matrix":
            commands.import_matrix(spark, a.out, a.list, a.matrix, a.matrix_list)
        elif a.command == "pop":
            commands.pop(spark, a.matrix, a.list, a.out, a.npc, a.max_samples, a.seed, a.matrix_list)
        elif a.command == "gwas":
            traits, hits = commands.gwas(spark, a.matrix, a.list, a.pheno, a.pop, a.k, a.npc, None if a.all else a.top_n, a.details, a.matrix_list)
            lines = tables.hit_lines(hits, traits, a.details)
            print("\t".join(lines.columns))
            for r in lines.toLocalIterator():
                print("\t".join(r))
        elif a.command == "gene":
            hits = commands.gene(spark, a.matrix, a.list, a.gene, a.k, a.matrix_list)
            for r in hits.orderBy(hits["kmer_code"].bitwiseXOR(-(2**63))).select("kmer", "pa_bits").toLocalIterator():
                print(f"{r['kmer']}\t{r['pa_bits']}")
        else:
            r = commands.check(spark, a.matrix, a.list, a.k, a.matrix_list).first()
            if not r["ok"]:
                print(*r["issues"], sep="\n", file=sys.stderr)
                return 1
            print(r["summary"])
    except PanelError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
