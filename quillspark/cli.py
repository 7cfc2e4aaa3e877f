"""Command line: codec tools on text, and ledger jobs on folders.

Calls to models are input rows: the jobs read what runs have stored. Exit codes: 0 done, 1 a check failed, 2 refused, 3 a
job took longer than its ``--max-seconds``.
"""

from __future__ import annotations

import argparse
import functools
import json
import sys
import threading
from collections.abc import Callable

from quillspark.operators import codec


def _entries(path: str | None) -> list[codec.Entry]:
    if not path:
        return []
    with open(path, encoding="utf-8") as f:
        tables = json.load(f)
    tables = tables if isinstance(tables, list) else [tables]
    return [codec.Entry(e["code"], e["expansion"], e.get("case_sensitive", True), t.get("name", "")) for t in tables for e in t["entries"]]


def _text(args: argparse.Namespace) -> str:
    if args.text is not None:
        return args.text
    return sys.stdin.read()


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("quillspark").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _rules(path: str | None) -> codec.Rules:
    """Register rules of one JSON file, or the default ones."""
    if not path:
        return codec.Rules()
    with open(path, encoding="utf-8") as f:
        r = json.load(f)
    return codec.Rules(
        tuple(r["drop_articles"]), tuple(r["drop_copulas"]), tuple(r["copula_next_verb_stoplist"]), tuple(r["copula_next_verb_suffixes"]), {d["word"]: d["derived"] for d in r["derivations"]}
    )


def encode(args: argparse.Namespace) -> int:
    coded, applied, skipped = codec.Codebook(_entries(args.codebook)).encode(_text(args))
    if args.register or args.rules:
        coded, dropped, _ = codec.encode_register(coded, _rules(args.rules))
        print(f"dropped {len(dropped)} words", file=sys.stderr)
    print(coded)
    print(f"applied {len(applied)}, skipped {len(skipped)}", file=sys.stderr)
    return 0


def decode(args: argparse.Namespace) -> int:
    text, unknown = codec.Codebook(_entries(args.codebook)).decode(_text(args))
    print(text)
    if unknown and args.strict:
        print(f"unknown code {unknown[0]!r}", file=sys.stderr)
        return 2
    return 0


def verify(args: argparse.Namespace) -> int:
    status, message = codec.verify(_text(args), _entries(args.codebook), _rules(args.rules), args.strict)
    print(message)
    return status


def tables(args: argparse.Namespace) -> int:
    entries = _entries(args.codebook)
    for e in sorted(entries, key=lambda e: (-len(e.expansion), e.expansion.casefold(), e.code.casefold())):
        print(f"{e.table}\t{e.code}\t{e.expansion}")
    faults = codec.invalid_codes(e.code for e in entries)
    for f in faults:
        print(f, file=sys.stderr)
    return 1 if faults else 0


def cipher(args: argparse.Namespace) -> int:
    plain, coded = codec.cipher_tables(args.seed)
    a, b = (coded, plain) if args.decode else (plain, coded)
    print(_text(args).translate(str.maketrans(a + a[:26].upper(), b + b[:26].upper())))
    return 0


def demo(args: argparse.Namespace) -> int:
    book = [codec.Entry("ETA", "estimated time of arrival"), codec.Entry("POB", "persons on board")]
    text = "the estimated time of arrival is noon, nineteen persons on board"
    coded, *_ = codec.Codebook(book).encode(text)
    print(text, coded, codec.Codebook(book).decode(coded)[0], sep="\n")
    return 0


def _job(run: Callable[..., None]) -> Callable[[argparse.Namespace], int]:
    """A job with a session: refused input ends it with 2, and all its Spark jobs are cancelled at its deadline, with 3."""

    @functools.wraps(run)
    def main_(args: argparse.Namespace) -> int:
        from quillspark.sources.scans import ScanError

        spark, late = _session(), threading.Event()

        def stop() -> None:
            late.set()
            spark.sparkContext.cancelAllJobs()

        timer = threading.Timer(args.max_seconds, stop) if args.max_seconds is not None else None
        try:
            if timer:
                timer.start()
            run(spark, args)
        except ScanError as error:
            print(f"error: {error}", file=sys.stderr)
            return 2
        except Exception:
            if not late.is_set():
                raise
        finally:
            if timer:
                timer.cancel()
        if late.is_set():
            print(f"error: not done within {args.max_seconds:g} seconds", file=sys.stderr)
            return 3
        return 0

    return main_


def _bank(spark, args: argparse.Namespace):
    """The tasks that the options ask for: of the first ``--passages`` by id, ``--task-limit`` from ``--task-offset`` on."""
    from quillspark.sources import scans

    tasks = scans.task_bank(spark, args.tasks)
    tasks = tasks.orderBy("id").limit(args.passages) if args.passages is not None else tasks
    if args.task_offset or args.task_limit is not None:
        n = tasks.count()
        if not 0 <= args.task_offset < n or (args.task_limit is not None and args.task_limit <= 0):
            raise scans.ScanError(f"no tasks {args.task_offset}+{args.task_limit} among {n}")
        tasks = tasks.orderBy("id").offset(args.task_offset)
        tasks = tasks.limit(args.task_limit) if args.task_limit is not None else tasks
    return tasks


def _records(spark, args: argparse.Namespace, tasks=None):
    from quillspark.sources import scans

    rows = scans.ledger(spark, *args.ledger)
    return rows if tasks is None else rows.join(tasks.selectExpr("id as task_id"), "task_id", "left_semi").select(*rows.columns)


def _out(args: argparse.Namespace) -> str:
    """Where results go: a slice has a folder of its own."""
    return f"{args.out}/slices/slice_{args.slice_id}" if getattr(args, "slice_id", None) else args.out


@_job
def regrade(spark, args: argparse.Namespace) -> None:
    from quillspark.plans import regrade as plan
    from quillspark.sources import scans, sinks

    bank = _bank(spark, args)
    result = plan.conditions_run(_records(spark, args, bank), scans.passages(bank))
    sinks.regraded_rows(result.rows, f"{_out(args)}/rows")
    for name in ("blocks", "ratios", "mcnemar", "tokens"):
        sinks.summary_json(getattr(result, name), f"{_out(args)}/{name}")


@_job
def baseline(spark, args: argparse.Namespace) -> None:
    from quillspark.plans import regrade as plan
    from quillspark.sources import scans, sinks

    bank = _bank(spark, args)
    records = _records(spark, args, bank)
    rows, grains = plan.quiz_run(records, scans.passages(bank))
    sinks.regraded_rows(rows, f"{_out(args)}/rows")
    sinks.summary_json(grains, f"{_out(args)}/grains")
    sinks.summary_json(plan.baseline_summary(records), f"{_out(args)}/summary")
    sinks.merge_ledger(records, f"{_out(args)}/ledger")


@_job
def baseline_merge(spark, args: argparse.Namespace) -> None:
    """The slices' ledgers as one, and its summary: as if the run had been a single one."""
    from quillspark.plans import experiment
    from quillspark.plans import regrade as plan
    from quillspark.sources import scans, sinks

    merged = experiment.merge(scans.ledger(spark, f"{args.out}/slices/slice_*/ledger"), f"{args.out}/ledger")
    sinks.summary_json(plan.baseline_summary(merged), f"{args.out}/summary")


@_job
def record_decode(spark, args: argparse.Namespace) -> None:
    from quillspark.plans import regrade as plan
    from quillspark.sources import scans, sinks

    bank = _bank(spark, args)
    texts = scans.passages(bank)
    mine = _records(spark, args, bank)
    source = scans.ledger(spark, *args.source).join(bank.selectExpr("id as task_id"), "task_id", "left_semi")
    verdicts = lambda rows, c: scans.source_verdicts(rows, None, texts).where(f"condition = '{c}'").drop("condition")
    row = plan.decode_summary(verdicts(mine, args.condition), verdicts(source, args.against), scans.source_tokens(source))
    sinks.summary_json(row, f"{_out(args)}/summary")


@_job
def lc_readability(spark, args: argparse.Namespace) -> None:
    from quillspark.plans import regrade as plan
    from quillspark.sources import scans, sinks

    bank = _bank(spark, args)
    texts = scans.passages(bank)
    answers, source = (scans.source_verdicts(rows, None, texts) for rows in (_records(spark, args, bank), scans.ledger(spark, *args.source)))
    sinks.summary_json(plan.readability(answers, source), f"{_out(args)}/summary")


@_job
def crossmodel(spark, args: argparse.Namespace) -> None:
    from quillspark.plans import experiment
    from quillspark.sources import scans, sinks

    records = _records(spark, args)
    answers = records.where("type = 'cond_answer'").select("panel", "condition", "task_id", "q_index", "question", "correct")
    sinks.summary_json(experiment.panel_summary(answers, scans.view(records, "panel_drop"), args.against, args.condition), f"{_out(args)}/summary")


@_job
def billing(spark, args: argparse.Namespace) -> None:
    from quillspark.plans import experiment
    from quillspark.sources import scans, sinks

    sinks.summary_json(experiment.billing(scans.view(_records(spark, args), "billing_record"), args.against, args.condition), f"{_out(args)}/summary")


@_job
def worklist(spark, args: argparse.Namespace) -> None:
    """All units of tasks and arms, or one of them by its number, as JSON."""
    from pyspark.sql import functions as F

    from quillspark.operators import ordering
    from quillspark.plans import experiment
    from quillspark.sources import scans, sinks

    if args.unit is None:
        arms = spark.createDataFrame([(a,) for a in args.arms], "arm string")
        skip = spark.createDataFrame([(*x.split(":", 1), "excluded") for x in args.skip or ()], "register string, arm string, reason string")
        sinks.worklist(*experiment.worklist(_bank(spark, args), arms, skip), args.out)
        return
    units = sinks.read_worklist(spark, args.out, "task_id string, arm string, register string, len_class string, reason string, skipped boolean").where("not skipped")
    found = units.orderBy("task_id", "arm").offset(args.unit).limit(1).select(F.to_json(F.struct("task_id", "arm", "register", "len_class")).alias("unit")).collect()
    if args.unit < 0 or not found:
        raise scans.ScanError(f"no unit {args.unit}")
    print(found[0].unit)


@_job
def merge(spark, args: argparse.Namespace) -> None:
    from quillspark.plans import experiment
    from quillspark.sources import scans

    experiment.merge(scans.slices(spark, args.slices), args.out)


@_job
def dictionary(spark, args: argparse.Namespace) -> None:
    from quillspark.plans import dictionary as plan
    from quillspark.sources import scans, sinks

    frames = scans.frames(spark, args.train)
    built = plan.build(frames, "frame_text", "seq", args.test)
    plan.check(frames, "frame_text", built)
    sinks.dictionary(built.codes(), args.out)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quillspark", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    for name, f in (("encode", encode), ("decode", decode), ("verify", verify), ("tables", tables)):
        p = sub.add_parser(name)
        p.add_argument("text", nargs="?")
        p.add_argument("--codebook")
        p.add_argument("--strict", action="store_true")
        p.add_argument("--register", action="store_true")
        p.add_argument("--rules")
        p.set_defaults(run=f)
    p = sub.add_parser("cipher")
    p.add_argument("text", nargs="?")
    p.add_argument("--seed", type=int, default=21)
    p.add_argument("--decode", action="store_true")
    p.set_defaults(run=cipher)
    sub.add_parser("demo").set_defaults(run=demo)
    def job(name: str, run: Callable[[argparse.Namespace], int], *positional: str, tasks: bool = False, **defaults: str) -> argparse.ArgumentParser:
        p = sub.add_parser(name)
        for x in positional:
            p.add_argument(x, nargs="+" if x == "ledger" else None)
        p.add_argument("--out", required=True)
        p.add_argument("--max-seconds", type=float)
        if tasks:
            p.add_argument("--tasks", required=True)
            p.add_argument("--passages", type=int)
            p.add_argument("--task-offset", type=int, default=0)
            p.add_argument("--task-limit", type=int)
            p.add_argument("--slice-id")
        for option, default in defaults.items():
            p.add_argument(f"--{option}", default=default)
        p.set_defaults(run=run)
        return p

    job("regrade", regrade, "ledger", tasks=True)
    job("baseline", baseline, "ledger", tasks=True)
    job("baseline-merge", baseline_merge)
    job("record-decode", record_decode, "ledger", tasks=True, condition="DECODE", against="A-FROM-PLAIN").add_argument("--source", nargs="+", required=True)
    job("lc-readability", lc_readability, "ledger", tasks=True).add_argument("--source", nargs="+", required=True)
    job("crossmodel", crossmodel, "ledger", condition="A-FROM-COMPRESSED", against="A-FROM-PLAIN")
    job("billing", billing, "ledger", condition="R-CABLESE", against="R-PLAIN")
    p = job("worklist", worklist, tasks=True)
    p.add_argument("--arms", nargs="+", default=["A"])
    p.add_argument("--skip", nargs="*")
    p.add_argument("--unit", type=int)
    job("merge", merge, "slices")
    job("dictionary", dictionary, "train").add_argument("--test", type=int, default=0)
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    return args.run(args)


if __name__ == "__main__":
    sys.exit(main())
