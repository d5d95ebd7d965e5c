"""Lines of text files keep their numbers when a file is read in many splits."""

from plenum.sources import readers


def test_lines_of_split_files(spark, tmp_path):
    long = [f"line {i} " + "x" * (i % 50) if i % 7 else "" for i in range(5000)]
    (tmp_path / "long.txt").write_text("\n".join(long))
    (tmp_path / "short.txt").write_text("a: one\n\n# no\nb: two")
    (tmp_path / "empty.txt").write_text("")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
        spark.conf.set("spark.sql.files.openCostInBytes", "1k")
        d = readers.read_lines(spark, str(tmp_path))
        assert d.rdd.getNumPartitions() > 1 and spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
        got = {}
        for r in d.collect():
            got.setdefault(r.path.rsplit("/", 1)[1], {})[r.pos] = r.line
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert got["long.txt"] == dict(enumerate(long)) and got["short.txt"] == {0: "a: one", 1: "", 2: "# no", 3: "b: two"} and "empty.txt" not in got
    script = readers.read_script(spark, str(tmp_path / "short.txt")).orderBy("pos").collect()
    assert [(r.pos, r.speaker, r.text) for r in script] == [(0, "a", "one"), (3, "b", "two")]
