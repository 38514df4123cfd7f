"""Small shell-like scripts over graphs: TOOL depth, TOOL makewindows, gunzip, head, tail, pipes and files.

The text is parsed to a list of steps, each step is a lazily evaluated table, and Spark plans them together:
nothing between two steps is written. A name written by > and read again in the same script stays a table.
Recognised commands, whatever tool name leads them:

    odgi depth -i GRAPH [-d | -r PATH | -b BED]      bedtools makewindows -b BED -w SIZE      gunzip [-c] FILE
    head [-n N] [FILE]      tail [-n N | -n +N] [FILE]

Depths come with a header line, which counts as a line. Where only the intervals of a depth are read on, paths are
measured and no depth is counted (path-length in the plan). Running other programs is not offered.
"""

from __future__ import annotations

import shlex
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequences import format_number
from ..operators import depth, positions
from ..sources import tables

STDIN = "/dev/stdin"


@dataclass
class Step:
    """One command: op, its options, and the names of its input and output ('|' for a pipe, None for the screen)."""

    op: str
    options: dict[str, str] = field(default_factory=dict)
    source: str | None = None
    target: str | None = None

    def __str__(self) -> str:
        parts = [self.op, *(f"{k}={v}" for k, v in self.options.items())]
        return f"{self.target or 'stdout'} <- {' '.join(parts)}" + (f" [{self.source}]" if self.source else "")


class ScriptError(ValueError):
    pass


_FLAGS = {"depth": {"-d": False, "-i": True, "-r": True, "-b": True}, "makewindows": {"-b": True, "-w": True}, "gunzip": {"-c": False}, "head": {"-n": True}, "tail": {"-n": True}}


@dataclass(frozen=True)
class Table:
    """Rows in the order of ord (and win), and the header line above them; None for none."""

    rows: DataFrame
    header: tuple[str, ...] | None = None


def parse(text: str) -> list[Step]:
    steps: list[Step] = []
    for command_line in (part for line in text.split("\n") for part in _split(line, ";")):
        pipeline = _split(command_line, "|")
        for i, command in enumerate(pipeline):
            step = _command(shlex.split(command, comments=True))
            if i:
                step.source = "|"
            if i < len(pipeline) - 1:
                step.target = "|"
            steps.append(step)
    return steps


def _split(text: str, mark: str) -> list[str]:
    lexer = shlex.shlex(text, posix=False, punctuation_chars=";|&<>")
    lexer.whitespace_split = True
    out, part = [], []
    for token in lexer:
        if token in ("&", "&&", "||", ">>"):
            raise ScriptError(f"{token} is not supported")
        if token == mark:
            out.append(" ".join(part))
            part = []
        else:
            part.append(token)
    out.append(" ".join(part))
    return [x for x in out if x.strip()]


def _command(words: list[str]) -> Step:
    step = Step("")
    plain = []
    i = 0
    while i < len(words):
        if words[i] in ("<", ">"):
            if i + 1 == len(words):
                raise ScriptError("a file name is missing")
            if words[i] == "<":
                step.source = words[i + 1]
            else:
                step.target = words[i + 1]
            i += 2
        else:
            plain.append(words[i])
            i += 1
    name = plain[1] if len(plain) > 1 and plain[1] in ("depth", "makewindows") else plain[0]
    if name not in _FLAGS:
        raise ScriptError(f"not a known command: {' '.join(plain)}")
    rest = plain[2:] if plain[0] != name else plain[1:]
    while rest:
        flag = rest.pop(0)
        if flag in _FLAGS[name]:
            step.options[flag] = rest.pop(0) if _FLAGS[name][flag] and rest else ""
        elif name == "gunzip" or name in ("head", "tail") and not flag.startswith("-"):
            step.source = flag
        elif name in ("head", "tail") and flag.startswith("-n"):
            step.options["-n"] = flag[2:]
        else:
            raise ScriptError(f"{name}: unknown option {flag}")
    step.op = name
    return step


def explain(steps: list[Step]) -> str:
    return "\n".join(map(str, steps))


def optimized(steps: list[Step]) -> list[Step]:
    """A depth of paths whose means nobody reads becomes path-length."""
    out = []
    for i, step in enumerate(steps):
        following = steps[i + 1] if i + 1 < len(steps) else None
        if step.op == "depth" and step.target == "|" and following.op == "makewindows" and not step.options.keys() & {"-d", "-b"}:
            step = replace(step, op="path-length")
        out.append(step)
    return out


def run(spark: SparkSession, text: str, only_plan: bool = False) -> list[Table] | str:
    """Run a script. Tables for the screen are returned, those for files written as tab-separated text."""
    steps = optimized(parse(text))
    if only_plan:
        return explain(steps)
    held: dict[str, Table] = {}
    shown: list[Table] = []
    for step in steps:
        out = _run(spark, step, held)
        if step.target is None:
            shown.append(out)
        else:
            held[step.target] = out
            if step.target != "|":
                write_table(out, step.target)
    return shown


def _run(spark: SparkSession, step: Step, held: dict[str, Table]) -> Table:
    def bed(name: str) -> DataFrame:
        name = (step.source or STDIN) if name == STDIN else name
        return held[name].rows if name in held else tables.read_bed(spark, name)

    if step.op == "gunzip":
        return Table(spark.createDataFrame([(step.source,)], "path string"))  # text readers decompress by suffix
    if step.op == "makewindows":
        rows = positions.make_windows(bed(step.options["-b"]), int(step.options["-w"]))
        return Table(rows.withColumn("ord", F.struct("ord", "win")).select("ord", "name", "start", "end"))
    if step.op in ("head", "tail"):
        name = step.source or "|"
        table = held[name] if name in held else Table(tables.read_bed(spark, name))
        return _cut_lines(table, step.op, step.options.get("-n", "10"))
    name = step.options.get("-i") or step.source
    if name in (STDIN, "|", None):
        name = held["|"].rows.first()["path"]
    g = tables.load(spark, name)
    asked = [step.options["-r"]] if "-r" in step.options else None
    if "-b" in step.options:
        return Table(positions.interval_depth(g, bed(step.options["-b"])), PATH_HEADER)
    if "-d" in step.options:
        return Table(depth.segment_depth(g).select(F.col("seg_id").alias("ord"), "name", "depth", "uniq"), SEGMENT_HEADER)
    if step.op == "path-length":
        if asked and depth.named_paths(g, asked).isEmpty():
            raise ScriptError(f"no such path: {asked[0]}")
        return Table(depth.as_bed(depth.path_length(g, asked)))
    rows = depth.path_depth(g, asked, strict=True)
    place = F.col("ord") if asked else F.col("path_id").alias("ord")
    return Table(rows.select(place, "name", F.lit(0).cast("long").alias("start"), F.col("length").alias("end"), "mean_depth"), PATH_HEADER)


PATH_HEADER = ("#path", "start", "end", "mean.depth")
SEGMENT_HEADER = ("#node.id", "depth", "depth.uniq")


def _cut_lines(table: Table, op: str, count: str) -> Table:
    """The first or last lines; the header is the first of all. Sorted limits, so no task sorts the whole table."""
    try:
        n = int(count)
    except ValueError:
        raise ScriptError(f"{op}: not a number of lines: {count}") from None
    top = 0 if table.header is None else 1
    order = [F.col(c) for c in ("ord", "win") if c in table.rows.columns]
    if op == "head":
        if n < 0:
            raise ScriptError("head: all but the last lines are not offered")
        return Table(table.rows.orderBy(*order).limit(max(0, n - top)), table.header if n else None)
    if count.startswith("+"):
        skipped = max(0, max(n, 1) - 1 - top)
        return Table(table.rows.orderBy(*order).offset(skipped) if skipped else table.rows, table.header if n <= 1 else None)
    n = abs(n)
    rows = table.rows.orderBy(*(c.desc() for c in order)).limit(n)
    return Table(rows, table.header if top and n > table.rows.limit(n).count() else None)


def table_text(table: Table) -> str:
    """The header, then rows by ord as tab-separated text; means with two digits."""
    df = table.rows
    shown = [c for c in df.columns if c not in ("ord", "win", "covered", "path_id", "seg_id", "weighted")]
    lines = ["\t".join(table.header)] if table.header else []
    for r in df.orderBy(*[c for c in ("ord", "win") if c in df.columns]).toLocalIterator():
        lines.append("\t".join(format_number(r[c]) if isinstance(r[c], float) else str(r[c]) for c in shown))
    return "".join(line + "\n" for line in lines)


def write_table(table: Table, path: str) -> None:
    """One text file, as a shell's > makes it; rows pass through the driver a partition at a time."""
    with open(path, "w") as f:
        f.write(table_text(table))
