"""Command line: python -m braidgraph.cli [-I GRAPH] COMMAND ...

Graph output goes to -O FILE as text, to -o FOLDER as a bundle, or to the screen.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.sequences import format_number
from .operators import accessors, depth, extract, links, positions, reads, transforms
from .plans import script
from .plans.graph import Graph
from .sources import gfa_text, json_graph, tables, text


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="braidgraph", description=__doc__)
    p.add_argument("-I", "--input", help="graph: text, .gz or a bundle")
    p.add_argument("-o", "--output", help="write the graph as a bundle")
    p.add_argument("-O", "--text-output", help="write the graph as text")
    sub = p.add_subparsers(dest="command")

    def add(name: str, *args, **more) -> None:
        c = sub.add_parser(name, **more)
        for names, options in args:
            c.add_argument(*names, **options)

    flag, number = {"action": "store_true"}, {"type": int}
    add("toc", (["-b"], flag))
    add("paths")
    add("stats", (["-S"], flag), (["-L"], flag))
    add("position", (["-p"], {"required": True}))
    add("extract", (["-n"], number | {"required": True}), (["-c"], number | {"required": True}), (["-d"], number | {"default": 300_000}), (["-e"], number | {"default": 6}))
    add("depth", (["-d"], flag), (["-r"], {"action": "append"}), (["-b"], {}), (["--subset"], {}))
    add("chop", (["-c"], number | {"required": True}), (["-l"], flag), (["--drop-empty"], flag))
    add("gaf", (["file"], {}), (["-s"], flag), (["-b"], flag))
    add("wcl", (["file"], {}))
    add("bed", (["-a"], {"required": True}), (["-b"], {"required": True}))
    add("seq-export", (["source"], {}), (["target"], {}))
    add("seq-import", (["source"], {}))
    add("matrix", (["files"], {"nargs": "+"}))
    add("window-depth", (["path"], {}), (["size"], number))
    add("crush")
    add("flip")
    add("inject", (["--bed"], {"required": True}))
    add("norm", (["--nl"], flag))
    add("degree")
    add("flatten", (["--name"], {"default": "graph"}))
    add("adjacency")
    add("overlap", (["--paths"], {"required": True}))
    add("somepaths", (["percent"], number))
    add("validate")
    add("validate-setup")
    add("inject-setup")
    add("json", (["--depth-only"], flag), (["-n"], number), (["-e"], number), (["-p"], number), (["--subset"], {}))
    add("from-json", (["file"], {}))
    add("script", (["-c"], {"dest": "code"}), (["-p"], flag), (["file"], {"nargs": "?"}))
    return p


def _text(path: str) -> str:
    with open(path) as f:
        return f.read()


def _rows(df: DataFrame, *order: str):
    return df.orderBy(*order).toLocalIterator()


def main(argv: list[str] | None = None, spark: SparkSession | None = None, out=None) -> int:
    a, out = _parser().parse_args(argv), out or sys.stdout
    spark = spark or SparkSession.builder.appName("braidgraph").getOrCreate()
    say = lambda *fields: print(*fields, sep="\t", file=out)
    c = a.command
    if c == "bed":
        for r in _rows(positions.bed_intersect(tables.read_bed(spark, a.a), tables.read_bed(spark, a.b)), "a_ord", "b_ord"):
            say(r["name"], r["start"], r["end"])
        return 0
    if c == "seq-export":
        tables.export_sequence(a.source, a.target)
        return 0
    if c == "seq-import":
        say(tables.import_sequence(a.source))
        return 0
    if c == "wcl":
        say(text.line_count(spark, a.file))
        return 0
    if c == "script":
        # Without code or a file, lines are read and run one by one, as a shell does.
        sources = [a.code] if a.code else [_text(a.file)] if a.file else sys.stdin
        for code in sources:
            try:
                shown = script.run(spark, code, only_plan=a.p)
            except script.ScriptError as e:
                if a.code or a.file:
                    raise
                print(e, file=sys.stderr)
                continue
            out.write(shown + "\n" if isinstance(shown, str) else "".join(map(script.table_text, shown)))
        return 0
    if c == "from-json":
        with open(a.file) as f:
            return _dump(json_graph.load(spark, f.read()), a, out)
    if not a.input:
        print("a graph is needed: -I FILE", file=sys.stderr)
        return 2
    return _on_graph(a, tables.load(spark, a.input), spark, say, out)


def _on_graph(a, g: Graph, spark: SparkSession, say, out) -> int:
    c = a.command
    if c is None:
        return _dump(g, a, out)
    if c == "toc":
        sizes = {r["pool"]: r["size"] for r in accessors.table_of_contents(g, a.b).collect()}
        for pool in accessors.ELEMENT_BYTES:
            say(pool, sizes[pool])
    elif c == "paths":
        for r in _rows(accessors.path_names(g), "path_id"):
            say(r["name"])
    elif c == "stats":
        if a.S or not a.L:
            say("#length", "nodes", "edges", "paths", "steps")
            say(*accessors.graph_stats(g).first())
        if a.L:
            r = accessors.self_loops(g).first()
            say("#type", "num")
            say("total", r["total"])
            say("unique", r["unique"])
    elif c == "position":
        name, offset, direction = a.p.split(",")
        if direction != "+":
            raise ValueError("only + is known")
        for r in positions.positions(g, spark.createDataFrame([(name, int(offset))], "name string, offset long")).collect():
            say("#source.path.pos", "target.graph.pos")
            say(a.p, f"{r['seg_name']},{r['seg_offset']},{'+' if r['fwd'] else '-'}")
    elif c == "extract":
        return _dump(extract.extract(g, a.n, a.c, a.d, a.e), a, out)
    elif c == "depth":
        _depth(a, g, spark, say)
    elif c == "chop":
        return _dump(transforms.chop(g, a.c, a.l, a.drop_empty), a, out)
    elif c == "gaf":
        found = tables.read_gaf(spark, a.file)
        if a.b:
            say(reads.chunk_count(g, found).first()["chunks"])
        elif a.s:
            for r in _rows(reads.read_sequences(g, found), "file", "read_ord"):
                say(r["name"], r["seq"])
        else:
            for r in _rows(reads.read_descriptions(g, found), "file", "read_ord"):
                say(r["name"])
                out.write(r["text"])
    elif c == "matrix":
        for file in a.files:
            out.write(_matrix_row(g, spark, file) + "\n")
    elif c == "window-depth":
        for r in _rows(positions.window_depth(g, a.path, a.size), "ord", "win"):
            say(r["name"], r["start"], r["end"], format_number(r["mean_depth"]))
    elif c == "crush":
        out.write(gfa_text.text_of(gfa_text.canonical_lines(transforms.crush(g))))
    elif c == "flip":
        out.write(gfa_text.text_of(gfa_text.canonical_lines(transforms.flip(g))))
    elif c == "inject":
        out.write(gfa_text.text_of(gfa_text.canonical_lines(transforms.inject(g, tables.read_injections(spark, a.bed)), links=False)))
    elif c == "norm":
        out.write(gfa_text.text_of(gfa_text.canonical_lines(g, links=not a.nl)))
    elif c == "degree":
        say("#node.id", "node.degree")
        for r in _rows(accessors.degree(g), "seg_id"):
            say(r["name"], r["degree"])
    elif c == "flatten":
        say(f">{a.name}")
        for r in _rows(transforms.fasta_lines(g), "line_no"):
            say(r["text"])
        say("#name", "start", "end", "path.name", "strand", "step.rank")
        for r in _rows(transforms.flatten_bed(g, a.name), "path_id", "rank"):
            say(*(r[x] for x in ("name", "start", "end", "path_name", "strand", "rank")))
    elif c == "adjacency":
        out.write(" ".join(map(str, accessors.adjacency_matrix_header(g).first())) + "\n")
        for r in _rows(accessors.adjacency_matrix(g), "from_name", "to_name"):
            out.write(f"{r['from_name']} {r['to_name']} {r['value']}\n")
    elif c == "overlap":
        found = list(_rows(links.path_overlaps(g, tables.read_names(spark, a.paths)), "ord", "other_id"))
        if found:
            say("#path", "start", "end", "path.touched")
        for r in found:
            say(r["name"], r["start"], r["end"], r["other"])
    elif c == "somepaths":
        for r in _rows(transforms.sampled_names(g, a.percent), "ord"):
            say(r["name"])
    elif c == "validate":
        for r in _rows(links.missing_link_messages(g), "path_id", "step_idx"):
            say(r["message"])
    elif c == "validate-setup":
        out.write(gfa_text.text_of(gfa_text.canonical_lines(transforms.drop_some_links(g))))
    elif c == "inject-setup":
        for row in transforms.random_bed(g):
            say(*row)
    elif c == "json":
        subset = tables.read_names(spark, a.subset) if a.subset else None
        sizes = {"max_n": a.n, "max_e": a.e, "max_p": a.p, "subset": subset}
        out.write(json.dumps(json_graph.depth_object(g, **sizes), indent=2, sort_keys=True) if a.depth_only else json_graph.dump(g, **sizes))
        out.write("\n")
    return 0


def _matrix_row(g: Graph, spark: SparkSession, file: str) -> str:
    found = tables.read_gaf(spark, file, walks_only=True).withColumn("file", F.lit(file))
    row = reads.presence_rows(g, found, spark.createDataFrame([(file,)], "file string")).first()
    return "".join("1" if x else "0" for x in row["cells"]) if row else ""


def _depth(a, g: Graph, spark: SparkSession, say) -> None:
    if a.d or a.subset:
        names = tables.read_names(spark, a.subset) if a.subset else None
        say("#node.id", "depth", "depth.uniq")
        for r in _rows(depth.segment_depth(g, names), "seg_id"):
            say(r["name"], r["depth"], r["uniq"])
    elif a.b:
        for r in _rows(positions.interval_depth(g, tables.read_bed(spark, a.b)), "ord"):
            say(r["name"], r["start"], r["end"], format_number(r["mean_depth"]))
    else:
        say("#path", "start", "end", "mean.depth")
        for r in _rows(depth.path_depth(g, a.r), "ord" if a.r else "path_id"):
            say(r["name"], 0, r["length"], format_number(r["mean_depth"]))


def _dump(g: Graph, a, out) -> int:
    if a.output:
        tables.write_bundle(g, a.output)
    elif a.text_output:
        gfa_text.write_gfa(g, a.text_output)
    else:
        out.write(gfa_text.text_of(gfa_text.preserved_lines(g) if g.lines is not None else gfa_text.normalized_lines(g)))
    return 0


if __name__ == "__main__":
    sys.exit(main())
