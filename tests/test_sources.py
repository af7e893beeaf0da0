"""Readers, parsers and writers over hand-written files."""

from pyspark.sql import functions as F

from quillgraph.functions import names
from quillgraph.operators import references
from quillgraph.sources import law, readers, sinks

HEADER = "Authors,Title,Year,Source title,Volume,Page start,Page end,Cited by,DOI,Abstract,Author Keywords,Index Keywords,References,EID,FA"


def write(tmp_path, name, text, encoding="utf-8"):
    path = tmp_path / name
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_bibliographic_csv(spark, tmp_path):
    rows = ['"Chen, J.S., Wang, A.B.","A ""quoted"" title",2001,Journal X,12,S34,56,7,10.1/A,Some text,"Word One; Two","Three","Lee, K., Other (1999) Journal Y, 3 (1), pp. 5-9",2-s2.0-1,4', "", ',,,,,,,,,,,,,,', '"Lee, K.",Other,1999,Journal Y,3,5,9,,,,,,,2-s2.0-2,0']
    path = write(tmp_path, "a.csv", "﻿" + "\n".join([HEADER, *rows]))
    docs = readers.read_bibliographic_csv(spark, path)
    got = {r.doc_id: r for r in docs.collect()}
    a, b = got["2-s2.0-1"], got["2-s2.0-2"]
    assert (a.title, a.year, a.volume, a.bpage, a.epage, a.times_cited, a.doi, a.family_id) == ('A "quoted" title', 2001, 12, 34, 56, 7, "10.1/a", "4")
    assert a.authors == ["chen, js", "wang, ab"] and a.author_keywords == ["word one", "two"] and b.family_id is None and b.times_cited == 0
    refs = references.parse_prose(references.split_references(docs))
    assert [(r.src, r.dst, r.rule) for r in references.resolve_prose(refs, docs).collect()] == [("2-s2.0-2", "2-s2.0-1", "author")]


def test_missing_columns_are_told(spark, tmp_path):
    import pytest

    with pytest.raises(ValueError, match="missing columns"):
        readers.read_bibliographic_csv(spark, write(tmp_path, "b.csv", "Authors,Title\nx,y"))


def test_tagged_tsv(spark, tmp_path):
    path = write(tmp_path, "w.txt", "UT\tAU\tPY\tSO\tTC\tDE\tCR\tVL\tBP\nWOS:001\tChen, J.S.; Wang, A\t2001\tJ X\t3\tone; two\tLEE K, 1999, J Y, V3, P5; DOE J, 1990, BOOK\t12\t34\nISI:002\tLee, K\t1999\tJ Y\t0\t\t\t3\t5\n")
    docs = readers.read_tagged_tsv(spark, path)
    got = {r.doc_id: r for r in docs.collect()}
    assert got["001"].authors == ["chen, js", "wang, a"] and got["001"].year == 2001 and got["002"].bpage == 5
    refs = references.parse_tagged(references.split_references(docs))
    assert [(r.src, r.dst, r.rule) for r in references.resolve_tagged(refs, docs).collect()] == [("002", "001", "nyvp")]


def test_author_formats(spark):
    df = spark.createDataFrame([("Chen J.S., Wang A.B.",), ("Van Dam K.",)], "Authors string")
    assert not names.uses_comma_pairs(df) and names.uses_comma_pairs(spark.createDataFrame([("Chen, J.S., Wang, A.B.",)], "Authors string"))
    assert [r.author_names for r in names.authors(df).collect()] == [["chen, js", "wang, ab"], ["van dam, k"]]


def test_reference_authors(spark):
    cases = {"SCHREIBER M": "schreiber, m", "VAN DER BERG J. P.": "van der berg, jp", "DE SOLLA D": "de solla, d", "SMITH J-A": "smith, ja", "PLATO": "plato"}
    df = spark.createDataFrame([(k,) for k in cases], "n string").select("n", names.reference_author(F.col("n")).alias("x"))
    assert {r.n: r.x for r in df.collect()} == cases


def test_tagged_references(spark):
    cases = {
        "LEE K, 1999, J Y, V3, P5, DOI 10.1/X": ("journal", 1999, "J Y", 3, 5, "10.1/X"), "LEE K, 1999, J Y, V3, PA5": ("journal", 1999, "J Y", 3, None, None), "LEE K, 1999, BOOK, P5": ("proceeding", 1999, "BOOK", None, 5, None),
        "LEE K, 1999, Patent No 5": ("patent", 1999, "Patent No 5", None, None, None), "*REPORT, 2001, X": ("report", None, None, None, None, None), "[Anonymous], 2001, X": ("xauthor", 2001, "X", None, None, None),
        "1999, J Y, V3, P5": ("journal", 1999, "J Y", 3, 5, None), "LEE K, J Y, V3, P5": ("journal", None, "J Y", 3, 5, None), "LEE K, 1999, J Y, DOI DOI 10.1/x": ("other", 1999, "J Y", None, None, "10.1/x"), "LEE K, 1999, J Y, V3, P5, DOI [10.1/a": ("journal", 1999, "J Y", 3, 5, "10.1/a"),
    }
    df = spark.createDataFrame([("d", i, k) for i, k in enumerate(cases)], "doc_id string, ref_pos int, raw string")
    assert {r.raw: (r.type, r.year, r.jname, r.volume, r.page, r.doi) for r in references.parse_tagged(df).collect()} == cases


def test_tagged_rules(spark):
    docs = spark.createDataFrame([("a", 1999, 3, 5, 9, "10.1/x", "lee, k"), ("b", 2002, 7, 1, 2, None, "doe, j"), ("c", 2001, None, None, None, None, "roe, r")], "doc_id string, year int, volume int, bpage int, epage int, doi string, first_author string")
    raw = ["LEE K, 1999, J, V3, P5", "LEE K, 1999, J, V3", "LEE K, 1999, J, P5", "LEE K, 1999, J", "X Y, 1900, J, V1, P1, DOI 10.1/X", "DOE J, 2002, J, V7, P1", "ROE R, 2001, J", "LEE K, 1999, J, V4, P5"]
    refs = references.parse_tagged(spark.createDataFrame([("c", i, r) for i, r in enumerate(raw)], "doc_id string, ref_pos int, raw string"))
    assert {(r.ref_pos, r.src, r.rule) for r in references.resolve_tagged(refs, docs).collect()} == {(0, "a", "nyvp"), (1, "a", "nyv"), (2, "a", "nyp"), (3, "a", "ny"), (4, "a", "doi")}


def test_doi_keeps_its_semicolons(spark):
    df = spark.createDataFrame([("d", "A B, 1999, J, DOI 10.1/FOO;2-x; C D, 2000, K")], "doc_id string, refs string")
    assert [r.raw for r in references.split_references(df).collect()] == ["A B, 1999, J, DOI 10.1/FOO;2-x", "C D, 2000, K"]


CASE = """junk
   (Cite as: 1 U.S. 2, 3 S.Ct. 4)
RED FLAG
                         Argued March 1, 1990.
                         Decided: June 2, 1991.
                         KEYCITE
line one
line two
Citing References
                         Negative Cases (U.S.A.)
Distinguished by

RED 1 Smith v. Jones, 5 F.2d 6, ** (2d Cir. 1995)

YEL 2 Roe v. Poe, 7 F.3d 8,
*** HN 3 (D.C. 1999)

                         Positive Cases (U.S.A.)
**** Examined

3 Doe v. Moe, 9 F.3d 10, 11 (1998)

** Cited

4 Foo v. Bar, 11 F.3d 12 (2000)

"""


def test_case_law(spark, tmp_path):
    write(tmp_path, "one.txt", CASE)
    path = str(tmp_path / "*.txt")
    c = law.read_cases(spark, path).first()
    assert (c.case_id, c.alt_ids, c.flag, c.year, c.argued_year) == ("1_U.S._2", ["3_S.Ct._4"], "RED", 1991, 1990)
    cites = law.read_case_citations(spark, path)
    assert {(r.cited, r.citing, r.weight) for r in cites.collect()} == {("1_U.S._2", "5_F.2d_6", -2), ("1_U.S._2", "7_F.3d_8", -3), ("1_U.S._2", "9_F.3d_10", 4), ("1_U.S._2", "11_F.3d_12", 2)}
    assert law.read_case_citations(spark, path, (4,)).count() == 1
    cases = spark.createDataFrame([("P", ["9_F.3d_10"])], "case_id string, alt_ids array<string>")
    assert "P" in {r.citing for r in law.primary_ids(cites, cases).collect()}


def test_lists_and_edges(spark, tmp_path):
    assert [r.term for r in readers.read_terms(spark, write(tmp_path, "t.txt", "﻿One\n\n Two \n")).orderBy("pos").collect()] == ["one", "two"]
    assert {(r.variant, r.canonical) for r in readers.read_aliases(spark, write(tmp_path, "al.txt", "A x\tB\nbroken\nA x\tB\n")).collect()} == {("a x", "b")}
    edges = readers.read_edges(spark, write(tmp_path, "e.txt", "  a b\n c\td 2.5\nbad\n")).collect()
    assert {(r.src, r.dst, r.weight) for r in edges} == {("a", "b", 1.0), ("c", "d", 2.5)}
    assert readers.read_edges(spark, write(tmp_path, "e2.txt", "a;b;3\n"), "semicolon").first().weight == 3.0
    con = readers.read_concordance(spark, write(tmp_path, "c.txt", "ISIC\tIPC\t%\tSECTOR\n10\tA01B\t50\tFarm\n")).first()
    assert tuple(con) == ("A01B", "10", 50.0, "Farm")
    clans = readers.read_clans(spark, write(tmp_path, "cl.txt", "*** HEAD ***\nAuthor\t200\tEpstein\n"))
    members = spark.createDataFrame([("d", "Author", "epstein, j"), ("e", "Author", "other")], "doc_id string, kind string, value string")
    assert [tuple(r) for r in readers.clan_weights(members, clans).collect()] == [("d", 200.0)]


def test_utf16(spark, tmp_path):
    assert readers.read_terms(spark, write(tmp_path, "u.txt", "Größe\n", "utf-16"), "UTF-16").first().term == "größe"


def test_pajek_round_trip(spark, tmp_path):
    nodes = spark.createDataFrame([("x", 'X "1"'), ("y", "Y"), ("z", "Z")], "node string, alias string")
    edges = spark.createDataFrame([("x", "y", 2.0), ("y", "z", 1.5)], "src string, dst string, weight double")
    part = spark.createDataFrame([("x", 1), ("y", 2)], "node string, partition int")
    out = str(tmp_path / "net")
    sinks.write_pajek(out, nodes, edges, True, part)
    n, e, p = readers.read_pajek(spark, f"{out}/part*")
    assert {(r.id, r.label) for r in n.collect()} == {(1, "X '1'"), (2, "Y"), (3, "Z")}
    assert {(r.src, r.dst, r.weight, r.directed) for r in e.collect()} == {(1, 2, 2.0, True), (2, 3, 1.5, True)}
    assert {(r.id, r.partition) for r in p.collect()} == {(1, 1), (2, 2), (3, 999999)}


def test_text_sinks(spark, tmp_path):
    w = spark.createDataFrame([("a", "b", 1.0, 0.0), ("a", "c", 1.0, 3.0)], "src string, dst string, weight double, spx double")
    sinks.write_edges(w, str(tmp_path / "e"))
    assert {r.value for r in spark.read.text(str(tmp_path / "e")).collect()} == {"  a b", "  a c"}
    sinks.write_link_table(w, str(tmp_path / "l"))
    assert [tuple(r) for r in spark.read.csv(str(tmp_path / "l"), header=True).collect()] == [("a", "c", "3.0")]
    records = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "id string, v int")
    groups = spark.createDataFrame([("a", 1), ("b", 2)], "name string, group_id int")
    assert sinks.select_records(records, "id", groups).count() == 2 and sinks.select_records(records, "id", groups, 1).count() == 1
    sinks.bipartite_lines(spark.createDataFrame([("d", "t", 2)], "doc_id string, term string, weight int"), str(tmp_path / "b"))
    assert spark.read.text(str(tmp_path / "b")).first().value == "d\tt\t2"


def test_stream_of_references(spark, tmp_path):
    from quillgraph.streaming.refresh import refresh_edges

    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([("d", 0, "LEE K, 1999, J, V3, P5")], "doc_id string, ref_pos int, raw string").write.parquet(src)
    stream = spark.readStream.schema("doc_id string, ref_pos int, raw string").parquet(src)
    refresh_edges(stream, references.parse_tagged, out, str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(out).first().type == "journal"
