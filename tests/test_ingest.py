import os

import pytest
from pyspark.sql import functions as F

from riskline.operators import evaluate as Ev
from riskline.sources import mail as M

NBSP = " "

FILES = {
    "CEAS_08.csv": 'subject,body,sender,urls,receiver,label\n'
                   'Hello,"Line1\nLine2",a@b.com,1,me@x.org,1\n'
                   '"Say ""hi""",Body two,NA,0,,0\n',
    "Ling.csv": 'subject,body,label\nRe: x,Body,1\nQ,"",\n',
    "Enron.csv": 'subject,body\nMeeting,None\nnull,Budget\n',
    "Nazario.csv": f'body,Email Type\nWin money,Phishing Email\n{NBSP},Safe Email\n',
    "unknown.csv": 'body\nsomething\n',
    "A b.csv": 'text,label\nFree prize,spam\nLunch?,ham\nx,maybe\n',
    "emails.csv": 'Email Text,Email Type\nignored,Safe Email\n',
    "notes.CSV": 'body,label\nignored,1\n',
}

EXPECTED = sorted([
    ("hello line1 line2 a@b.com 1 me@x.org", 1, "CEAS_08.csv"),
    ('say "hi" body two  0', 0, "CEAS_08.csv"),
    ("re: x body", 1, "Ling.csv"),
    ("q", None, "Ling.csv"),
    ("meeting", 0, "Enron.csv"),
    ("budget", 0, "Enron.csv"),
    ("win money", 1, "Nazario.csv"),
    ("", 0, "Nazario.csv"),
    ("free prize", 1, "A b.csv"),
    ("lunch?", 0, "A b.csv"),
    ("x", None, "A b.csv"),
], key=lambda r: (r[2], r[0]))


@pytest.fixture
def mail_dir(tmp_dir):
    for name, body in FILES.items():
        with open(os.path.join(tmp_dir, name), "w", encoding="utf-8") as f:
            f.write(body)
    return tmp_dir


def test_listing(spark, mail_dir):
    names = [n for n, _ in M.list_csv_files(spark, mail_dir)]
    assert names == sorted(["A b.csv", "CEAS_08.csv", "Enron.csv", "Ling.csv", "Nazario.csv", "unknown.csv"])


def test_read_mail_dir(spark, mail_dir):
    df = M.read_mail_dir(spark, mail_dir)
    got = sorted([tuple(r) for r in df.select("text", "label", "source_file").collect()],
                 key=lambda r: (r[2], r[0]))
    assert got == EXPECTED


def test_drop_unusable_and_profiles(spark, mail_dir):
    df = M.read_mail_dir(spark, mail_dir)
    counts = Ev.row_counts(df, M.usable()).first()
    assert (counts.rows_before, counts.rows_after) == (11, 8)
    kept = M.drop_unusable(df)
    assert kept.count() == 8
    assert dict(tuple(r) for r in Ev.class_distribution(kept).collect()) == {0: 4, 1: 4}
    by_src = [tuple(r) for r in Ev.rows_by_source(kept).collect()]
    assert by_src == [("A b.csv", 2), ("CEAS_08.csv", 2), ("Enron.csv", 2), ("Ling.csv", 1), ("Nazario.csv", 1)]


def test_land_parquet(spark, mail_dir, tmp_dir):
    df = M.drop_unusable(M.read_mail_dir(spark, mail_dir))
    out = M.land(df, os.path.join(tmp_dir, "combined"))
    back = spark.read.parquet(out)
    assert sorted(map(tuple, back.select("text", "label", "source_file").collect())) == \
        sorted(map(tuple, df.select("text", "label", "source_file").collect()))


def test_empty_inputs(spark, tmp_dir):
    with pytest.raises(FileNotFoundError):
        M.read_mail_dir(spark, tmp_dir)
    with open(os.path.join(tmp_dir, "unknown.csv"), "w") as f:
        f.write("body\nx\n")
    with pytest.raises(ValueError):
        M.read_mail_dir(spark, tmp_dir)


def test_read_mail_csv_baseline(spark, tmp_dir):
    p = os.path.join(tmp_dir, "emails.csv")
    with open(p, "w") as f:
        f.write('Email Text,Email Type\n"multi\nline",Phishing Email\nNone,Safe Email\nok,Other\n')
    from riskline.functions.labels import strict_label
    df = M.valid_text(M.read_mail_csv(spark, p))
    rows = df.select("Email Text", strict_label(F.col("`Email Type`")).alias("y")).collect()
    assert [tuple(r) for r in rows] == [("multi\nline", 1), ("ok", None)]


def test_headers_differing_by_case(spark, tmp_dir):
    with open(os.path.join(tmp_dir, "CEAS_08.csv"), "w") as f:
        f.write("subject,text,Text,label\nS,lower one,Upper One,1\n")
    prev = spark.conf.get("spark.sql.caseSensitive")
    try:
        rows = [tuple(r) for r in M.read_mail_dir(spark, tmp_dir).collect()]
    finally:
        spark.conf.set("spark.sql.caseSensitive", prev)
    # only the exact name ``text`` is a candidate; ``Text`` is ignored
    assert rows == [("s lower one", 1, "CEAS_08.csv")]


def test_odd_headers_and_names(spark, tmp_dir):
    files = {
        "a b+c%41.csv": 'source_file,_path,file,id,body,Body,body,label\nx,y,z,9,first,no,second,1\n',
        "quoted.csv": '"sub\nject","subject",Email Type\n"a, ""b""",S,fraud\n,,ham\n',
        "short.csv": 'body,label\nonly\nb,0,more\n',
        "head.csv": 'body,label\n',
        "empty.csv": '',
    }
    for name, body in files.items():
        with open(os.path.join(tmp_dir, name), "w") as f:
            f.write(body)
    before = spark.conf.get("spark.sql.caseSensitive")
    got = sorted(map(tuple, M.read_mail_dir(spark, tmp_dir).collect()), key=str)
    assert spark.conf.get("spark.sql.caseSensitive") == before
    assert got == sorted([("first", 1, "a b+c%41.csv"), ("s", 1, "quoted.csv"), ("", 0, "quoted.csv"),
                          ("only", None, "short.csv"), ("b", 0, "short.csv")], key=str)
    with open(os.path.join(tmp_dir, "wide.csv"), "w") as f:
        f.write(",".join(["label", "body"] + ["c%d" % i for i in range(M.MAX_COLUMNS)]) + "\n1,x\n")
    with pytest.raises(ValueError, match="columns"):
        M.read_mail_dir(spark, tmp_dir)


def test_number_of_jobs_does_not_grow_with_files(spark, tmp_dir):
    def jobs(n):
        folder = os.path.join(tmp_dir, str(n))
        os.makedirs(folder)
        for i in range(n):
            with open(os.path.join(folder, f"m{i}.csv"), "w") as f:
                f.write(f"body,x{i},label\nt{i},1,{i % 2}\n")
        group = f"ingest-{n}"
        spark.sparkContext.setJobGroup(group, group)
        try:
            df = M.read_mail_dir(spark, folder)
            count = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert df.count() == n
        return count

    few, many = jobs(2), jobs(25)
    assert many == few


def test_one_large_file_is_read_by_many_tasks_as_by_one(spark, tmp_dir):
    odd = ['"line\nof ""quotes"", and\n\n\ncommas",1\n', '"odd" tail",0\n', '"" ,1\n', 'plain "text",0\n', '\n\n',
           'é "x\n,"""",1\n', f'"{"long, " * 3000}\n{"field " * 3000}",1\n', '"q" x"y"\n', 'a,b,c\n']
    with open(os.path.join(tmp_dir, "CEAS_08.csv"), "w", encoding="utf-8") as f:
        f.write("﻿body,label\n" + "".join(odd[i % len(odd)] for i in range(450)) + '"open\nto the end')
    with open(os.path.join(tmp_dir, "Ling.csv"), "w", newline="") as f:  # other line ends: the plain reader's
        f.write('body,label\r\n"a\r\nb",1\r\nlone\nend,0\r\n')
    paths = [p for _, p in M.list_csv_files(spark, tmp_dir)]
    whole = (M._csv_reader(spark).option("header", False).schema(M.CELL_SCHEMA).csv(paths)
             .select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file"),
                     F.monotonically_increasing_id().alias("id"), F.array(*M.CELLS).alias("cells")))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 4096)
    try:
        rows = M.land_rows(spark, paths)
        part = F.element_at(F.split("_metadata.file_path", "/"), -1)
        landed = [p for p in rows.inputFiles() if "mail-rows" in p]
        tasks = spark.read.parquet(*landed).where("file like '%CEAS%'").select(part).distinct().count()
        got = [(r.file.split("/")[-1], r.cells) for r in sorted(rows.collect(), key=lambda r: (r.file, r.id))]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == [(r.file, r.cells) for r in sorted(whole.collect(), key=lambda r: (r.file, r.id))]
    assert tasks > 20


def test_a_folder_of_parts_is_one_file(spark, tmp_dir):
    folder = os.path.join(tmp_dir, "a b+c%.csv")
    os.makedirs(folder)
    for k, body in enumerate(["body,label\nfirst,1\n", "body,label\nsecond,0\n", "body,label\n"]):
        with open(os.path.join(folder, f"part-{k}.csv"), "w") as f:
            f.write(body)
    with open(os.path.join(folder, "_SUCCESS"), "w"):
        pass
    got = sorted(map(tuple, M.read_mail_dir(spark, tmp_dir).collect()))
    assert got == [("first", 1, "a b+c%.csv"), ("second", 0, "a b+c%.csv")]
