"""Command line: run, stage, gtf-lookups, fasta-lookups, compare, rebuild-index."""

from __future__ import annotations

import argparse
import shlex
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chimerant.config import Config
from chimerant.operators import storage
from chimerant.plans import comparison, embedding, events, features, lookups, peptides, plots, retrieval, run as whole, scoring
from chimerant.sources import matrix, tables, writers


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="chimerant")
    sub = p.add_subparsers(dest="command", required=True)
    retrieval_ = argparse.ArgumentParser(add_help=False)
    mode = retrieval_.add_mutually_exclusive_group()
    mode.add_argument("--faiss", action="store_true", help="domains by search in the index (default)")
    mode.add_argument("--ips", action="store_true", help="domains by an annotator: --annotations or --annotator")
    retrieval_.add_argument("--index", help="Parquet index, or with --metadata a matrix file or flat index")
    retrieval_.add_argument("--metadata", help="metadata of the index (JSON or Parquet), where --index is a matrix file or flat index")
    retrieval_.add_argument("--annotations", help="output of an external annotator")
    retrieval_.add_argument("--annotator", help="an annotator's command line with {fasta} and {out}, run in batches")
    retrieval_.add_argument("--model", help="protein model as module:function; without it sequences are told apart by k-mers")
    retrieval_.add_argument("--gpu", type=int, help="GPUs of a machine that the model's tasks share")
    r = sub.add_parser("run", help="analyse an event table", parents=[retrieval_])
    r.add_argument("--input", required=True)
    r.add_argument("--lookups", required=True, help="folder of Parquet lookups")
    r.add_argument("--positives", required=True)
    pages = r.add_mutually_exclusive_group()
    pages.add_argument("--expression", help="coverage table")
    pages.add_argument("--arriba", "--pages", dest="pages", help="folder of documents of plot pages; needs --renderer and --symbols")
    r.add_argument("--renderer", help="renderer of documents as module:function")
    r.add_argument("--symbols", help="list of gene symbols")
    r.add_argument("--pictures", action="store_true", help="write pictures of the pages with markers and exons")
    r.add_argument("--out", default="output")
    r.add_argument("--delinter", "--delete-interim", dest="delete_interim", action="store_true")
    g = sub.add_parser("gtf-lookups")
    f = sub.add_parser("fasta-lookups")
    for x in (g, f):
        x.add_argument("--input", required=True)
        x.add_argument("--name", required=True)
        x.add_argument("--out", default="resources/lookups")
    c = sub.add_parser("compare")
    c.add_argument("--ips", required=True)
    c.add_argument("--faiss", required=True)
    c.add_argument("--out-rows", "--out_rows", default="output/statistics")
    c.add_argument("--out-stats", "--out_stats", default="output/statistics")
    c.add_argument("--id-col", default="id")
    c.add_argument("--name")
    b = sub.add_parser("rebuild-index", help="windows, embeddings and index, from the step that is named")
    step = b.add_mutually_exclusive_group(required=True)
    step.add_argument("--all", action="store_true", help="from annotator output and proteome")
    step.add_argument("--embeddings", action="store_true", help="from the windows of an earlier run")
    step.add_argument("--index", action="store_true", help="from the embeddings of an earlier run")
    b.add_argument("--hits", nargs="+", help="annotator chunks, merged")
    b.add_argument("--proteome")
    b.add_argument("--name", required=True, help="name of the index in the output folder")
    b.add_argument("--model", help="protein model as module:function; without it sequences are told apart by k-mers")
    b.add_argument("--gpu", type=int, help="GPUs of a machine that the model's tasks share")
    b.add_argument("--metric", choices=["ip", "l2"], default=Config().metric)
    b.add_argument("--out", default="resources/index")
    st = sub.add_parser("stage", help="run one stage of an analysis", parents=[retrieval_])
    st.add_argument("name", choices=sorted(STAGES))
    st.add_argument("input", help="the table of the stage before")
    st.add_argument("--lookups", default="resources/lookups", help="folder of Parquet lookups")
    st.add_argument("--positives", default="resources/positives.tsv")
    st.add_argument("--evaluate", action="store_true", help="hold out a share of the positives and write how well they are found")
    st.add_argument("--out", default="output/interim")
    return p


def _embedder(a, exact: bool):
    if a.model:
        return embedding.Pooled(a.model, exact, a.gpu)
    print("no --model: vectors are k-mer counts, which stand in for a protein model", file=sys.stderr)
    return retrieval.kmer_embedder()


def _peptides(spark, df, a):
    return peptides.build(df, _lookup(spark, a, "peptide"), _lookup(spark, a, "cds"))


def _domains(spark, df, a):
    if a.annotations:
        return retrieval.by_annotator(df, lambda _: tables.read_annotator(spark, a.annotations))
    if a.annotator:
        words = shlex.split(a.annotator)
        ledger = f"{storage.shared_folder(spark)}/annotator-{writers.stem_of(a.input)}"
        return retrieval.by_annotator(df, retrieval.command_annotator(lambda fasta, out: [w.format(fasta=fasta, out=out) for w in words], ledger))
    if a.ips:
        raise SystemExit("--ips needs --annotations or --annotator")
    index, cfg = _index(spark, a)
    if index is None:
        raise SystemExit("a search needs --index")
    return retrieval.by_search(df, index, _embedder(a, not cfg.parity), cfg)


def _index(spark, a) -> tuple[DataFrame | None, Config]:
    """The index and the settings of its search; a flat index brings its own metric."""
    at = a.index or ("resources/index/index" if a.command == "stage" else None)
    if not at or not a.metadata:
        return spark.read.parquet(at) if at else None, Config()
    return tables.load_index(spark, a.index, a.metadata), Config(metric=matrix.index_metric(spark, a.index) or Config().metric)


def _features(spark, df, a):
    return features.compute(df, *(_lookup(spark, a, n) for n in ("all_features", "mane", "cds")))


def _annotated(spark, df, a):
    return events.annotate(df, _lookup(spark, a, "all_features"), _lookup(spark, a, "next_gene"))


def _scores(spark, df, a):
    if not a.evaluate:
        return scoring.score(df, tables.load_table(spark, a.positives))
    out, held, metrics = scoring.evaluate(df, tables.load_table(spark, a.positives))
    writers.save_table(held, writers.stage_path(a.out, a.input, "holdout_scores", "tsv"))
    writers.save_table(metrics, f"{a.out}/pu_metrics.tsv")
    return out


def _lookup(spark, a, name: str):
    return spark.read.parquet(f"{a.lookups}/{name}_lookup")


STAGES = {"peptides": _peptides, "domains": _domains, "features": _features, "annotated": _annotated, "scores": _scores}


def run_stage(spark: SparkSession, a: argparse.Namespace) -> str:
    """One stage on the table of the stage before it; returns the path of its own."""
    path = tables.resolve(a.input)
    df = tables.load_events(spark, path) if a.name == "peptides" else tables.load_table(spark, path, ["id"])
    out = STAGES[a.name](spark, df, a)
    written = writers.save_table(out, writers.stage_path(a.out, a.input, a.name, "tsv"))
    if a.name == "peptides":
        writers.save_fasta(writers.fasta_records(out), writers.stage_path(a.out, a.input, a.name, "fasta"))
    if a.name == "annotated":
        writers.save_table(events.counts(tables.load_table(spark, written)), writers.stage_path(a.out, a.input, "event_counts", "tsv"))
    return written


def rebuild_index(spark: SparkSession, a: argparse.Namespace) -> None:
    """windows and metadata (Parquet), embeddings (a matrix in parts) and the flat index, in one folder; each step reads what the one before it wrote."""
    index = f"{a.out}/{writers.plain_name(a.name)}"
    if a.all:
        if not a.hits or not a.proteome:
            raise SystemExit("--all needs --hits and --proteome")
        proteins = tables.with_id(tables.read_fasta(spark, a.proteome)).select("protein_id", "sequence")
        found = retrieval.domain_windows(retrieval.merge_hits([tables.read_hits(spark, h) for h in a.hits]), proteins)
        found.write.mode("overwrite").parquet(f"{a.out}/windows")
    if not a.index:
        vectors = retrieval.build_index(spark.read.parquet(f"{a.out}/windows"), _embedder(a, True))
        vectors.write.mode("overwrite").parquet(f"{a.out}/vectors")
        vectors = spark.read.parquet(f"{a.out}/vectors").withColumn("pos", F.col("pos") - 1)  # a matrix counts its rows from 0
        vectors.drop("vec").write.mode("overwrite").parquet(f"{a.out}/metadata")
        matrix.save_vectors(vectors, f"{a.out}/embeddings", mode="overwrite")
    matrix.save_vectors(matrix.read_vectors(spark, f"{a.out}/embeddings"), index, a.metric, mode="overwrite")


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    try:
        return execute(spark, a)
    finally:
        storage.clear(spark)  # what a command leaves is in its output folder


def execute(spark: SparkSession, a: argparse.Namespace) -> int:
    if a.command == "run":
        names = ("peptide_lookup", "cds_lookup", "all_features_lookup", "mane_lookup", "next_gene_lookup")
        found = {n: spark.read.parquet(f"{a.lookups}/{n}") for n in names}
        expression = tables.load_table(spark, a.expression) if a.expression else None
        if a.pages:
            if not a.renderer or not a.symbols:
                raise SystemExit("plot pages need --renderer and --symbols")
            coverage, failed = plots.analyse(tables.list_documents(spark, a.pages), embedding.plugin(a.renderer), found["all_features_lookup"], tables.read_symbols(spark, a.symbols), pictures_in=f"{a.out}/expression/pictures" if a.pictures else None)
            writers.save_table(plots.for_events(coverage), f"{a.out}/expression/coverage.tsv")
            writers.save_json(coverage, f"{a.out}/expression/pages")
            for r in failed.limit(20).collect():
                print(f"left out: {r.document}: {r.failed}", file=sys.stderr)
            expression = plots.for_events(coverage)
        result = whole.run(tables.load_events(spark, tables.resolve(a.input)), found, tables.load_table(spark, a.positives), lambda df: _domains(spark, df, a), expression=expression, cfg=Config())
        writers.save_table(result.peptides, writers.stage_path(f"{a.out}/interim", a.input, "peptides", "tsv"))
        writers.save_fasta(writers.fasta_records(result.peptides), writers.stage_path(f"{a.out}/interim", a.input, "peptides", "fasta"))
        writers.save_table(result.counts, writers.stage_path(f"{a.out}/final", a.input, "event_counts", "tsv"))
        writers.save_table(result.complete, writers.stage_path(f"{a.out}/final", a.input, "complete_analysis", "tsv"))
        if a.delete_interim:
            writers.clear_files(f"{a.out}/interim", spark)
    elif a.command == "stage":
        print(run_stage(spark, a))
    elif a.command in ("gtf-lookups", "fasta-lookups"):
        if a.command == "fasta-lookups":
            writers.save_outputs(lookups.fasta_outputs(tables.read_fasta(spark, a.input)), "output", a.out, f"{a.name}_")
        else:
            for name, df in lookups.gtf_lookups(tables.read_gtf(spark, a.input)).items():
                writers.save_new(df, f"{a.out}/{a.name}_{name}")
    elif a.command == "compare":
        try:
            left, right = tables.load_table(spark, a.ips, [a.id_col]), tables.load_table(spark, a.faiss, [a.id_col])
        except ValueError as e:
            print(e, file=sys.stderr)
            return 2
        rows = comparison.rows(left, right, a.id_col)
        if rows.isEmpty():
            print("the tables share no id", file=sys.stderr)
            return 4
        name = a.name or writers.stem_of(a.ips)
        writers.save_table(rows, f"{a.out_rows}/{name}_comparison_rows.tsv")
        writers.save_table(comparison.stats(rows), f"{a.out_stats}/{name}_comparison_stats.tsv")
    else:
        rebuild_index(spark, a)
    return 0


if __name__ == "__main__":
    sys.exit(main())
