"""The command line, the whole chain from sequences to scaffolds, and the stream."""

import random

import pytest

from fragloom import cli
from fragloom.streaming.incremental import align_stream, stream_maps


def world(tmp_path, n=60):
    """A sequence cut at CTCGAG, its optical map, and query pieces of it."""
    rng = random.Random(7)
    sizes = [rng.randrange(2500, 9000) for _ in range(n)]
    dna, pieces = "", []
    for s in sizes:
        dna += "".join(rng.choice("ACT") for _ in range(s - 6)) + "CTCGAG"
    cuts = [sum(sizes[:k]) for k in range(n + 1)]
    for k, (a, b) in enumerate(((3, 20), (22, 38), (40, 57))):
        pieces.append((f"q{k}", dna[cuts[a] : cuts[b] + 50]))
    (tmp_path / "q.fa").write_text("".join(f">{i}\n{d}\n" for i, d in pieces))
    (tmp_path / "o.txt").write_text("chr 1\nXhoI B " + " ".join(f"{s / 1000:.3f}" for s in sizes) + "\n")
    (tmp_path / "e.txt").write_text("XhoI/C'TCGAG//\n")
    return sizes


def test_command_line_flags():
    o = cli.parser().parse_args(["c", "a", "b", "--local", "--noReverse", "--sdMax", "6", "--numPermutationTrials", "9", "--noBoundaries"])
    p = cli.params_of(o)
    assert (o.optical_map, p.local, p.reverse, p.sd_max, p.trials, p.boundaries, p.max_miss_rate) == (["a", "b"], True, False, 6, 9, False, 0.5)
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["only-one"])


def test_chain(spark, tmp_path):
    world(tmp_path)
    out = str(tmp_path / "out")
    cli.scaffold_chain(spark, str(tmp_path / "o.txt"), str(tmp_path / "q.fa"), str(tmp_path / "e.txt"), out)
    best = {r.contig_id: r for r in spark.read.parquet(f"{out}/unique").collect()}
    every = spark.read.parquet(f"{out}/all")
    top = {r.contig_id: r for r in every.filter("rank = 1").collect()}
    assert set(top) == {"q0", "q1", "q2"} and all(r.forward and r.chromosome == "chr1" for r in top.values())
    assert [abs(top[f"q{k}"].op_start_index - a) <= 1 for k, a in enumerate((3, 22, 40))] == [True] * 3
    assert set(best) <= set(top)
    text = "\n".join(r.value for r in spark.read.text(f"{out}/scaffolds_sig").collect())
    assert "Contigs Placed in Scaffold" in text and "chr1" in text


def test_p_values_of_true_placements_are_small(spark, tmp_path):
    from fragloom.params import Params
    from fragloom.sources import readers

    sizes = world(tmp_path)
    maps = readers.read_pair_lines(spark, str(tmp_path / "o.txt"))
    contigs = cli.digest(readers.read_fasta(spark, str(tmp_path / "q.fa")), "CTCGAG")
    got = cli.aligned(contigs, maps, Params(sd_max=4, trials=20)).filter("rank = 1").collect()
    assert len(got) == 3 and all(r.pval <= 0.05 for r in got) and sizes
    corrected = cli.corrected_maps(contigs, maps, Params(sd_max=4)).first()
    assert len(corrected.frags) == len(sizes) and max(abs(a - b) for a, b in zip(corrected.frags, sizes, strict=True)) < 100


def test_stream(spark, tmp_path):
    rng = random.Random(3)
    frags = [rng.randrange(500, 70000) for _ in range(80)]
    maps = spark.createDataFrame([("m", frags)], "map_id string, frags array<int>")
    src = tmp_path / "in"
    src.mkdir()
    for k in range(3):
        part = frags[10 * k : 10 * k + 14]
        (src / f"{k}.map").write_text("\t".join(map(str, [f"q{k}", sum(part), len(part), *part])) + "\nbad\t1\t2\t3\n")
    q = align_stream(stream_maps(spark, str(src)), maps, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).filter("rank = 1").collect()
    assert {r.contig_id: r.op_start_index for r in rows} == {f"q{k}": 10 * k for k in range(3)}
