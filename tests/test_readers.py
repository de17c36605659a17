from threatlake.sources.readers import read_raw


def test_objects_one_after_another(spark, tmp_path):
    path = tmp_path / "x.json"
    path.write_text('{"a": "1",\n "b": {"c": "}"}} {"a": "2"}\n{broken {"a": "3"} trailing')
    got = read_raw(spark, str(path), "concat_json").orderBy("seq").collect()
    assert [r.raw["a"] for r in got] == ["1", "2", "3"]
    (tmp_path / "empty.json").write_text("")
    assert read_raw(spark, str(tmp_path / "empty.json"), "concat_json").count() == 0


def test_exported_event_log(spark, tmp_path):
    path = tmp_path / "log.xml"
    path.write_text(
        """<Events><Event xmlns="urn:x"><System><Provider Name="P" Guid="{g}"/><EventID>4624</EventID><TimeCreated SystemTime="2024-01-02T03:04:05Z"/><Computer>h1</Computer></System>
        <EventData><Data Name="User">ann</Data><Data Name="User">bob</Data><Data Name="Empty"/></EventData></Event>
        <Event><System><EventID Qualifiers="0">1</EventID><Computer>h2</Computer></System></Event></Events>"""
    )
    one, two = (r.raw for r in read_raw(spark, str(path), "winevent_xml").orderBy("seq").collect())
    assert one["EventCode"] == "4624" and one["ComputerName"] == "h1" and one["User"] == "bob" and one["Provider"] == "P" and "Empty" not in one
    assert one["TimeCreated"] == "2024-01-02T03:04:05Z" and two["EventID"] == "1" and "User" not in two


def test_json_in_any_form(spark, tmp_path):
    """One object per line, an array, a wrapper, one object, objects over lines; zero and empty values are missing."""
    two = ['{"EventID": 1, "LogonType": 0, "x": {"y": 1}, "e": ""}', '{"EventID": "2", "LogonType": "0"}']
    forms = {"lines": "\n".join(two), "array": f"[{two[0]}, {two[1]}]", "wrapper": f'{{"records": [{",".join(two)}]}}', "run": "".join(two), "bom": "\ufeff" + f"[{two[0]}, {two[1]}]"}
    for name, text in forms.items():
        (tmp_path / f"{name}.json").write_text(text)
        got = [r.raw for r in read_raw(spark, str(tmp_path / f"{name}.json")).orderBy("seq").collect()]
        assert got == [{"EventID": "1", "x": '{"y": 1}'}, {"EventID": "2", "LogonType": "0"}], name
    (tmp_path / "one.json").write_text(two[1])
    assert read_raw(spark, str(tmp_path / "one.json")).count() == 1


def test_rows_with_lists_that_are_not_quoted(spark, tmp_path):
    header = "id,host.ip,host.mac,host.name,user"
    rows = ["1,a,m,h1,u", "2,a,b,c,m,h2,u", '3,"a,b",m,h3,u', "4,h4,u", "5,a,m", '6,"open,m,h6,u', "7,a,m,h7,u"]
    (tmp_path / "x.csv").write_text("\n".join([header, *rows]))
    got = {r.raw["id"]: r.raw for r in read_raw(spark, str(tmp_path / "x.csv"), "csv_realign").collect()}
    assert [got[k]["host.ip"] for k in "123"] == ["a", "a, b, c, m", "a,b"] and [got[k]["host.name"] for k in "13"] == ["h1", "h3"]
    assert got["2"]["host.mac"] == "h2" and got["2"]["host.name"] == "u" and got["2"]["user"] == "" and set(got) == set("1234567") and got["7"]["user"] == "u"


def test_lines_that_do_not_parse_and_attributes(spark, tmp_path):
    (tmp_path / "x.ndjson").write_text('{"a": "1"}\nbroken\n\n{"a": "2"}')
    from threatlake.sources.readers import corrupt

    assert read_raw(spark, str(tmp_path / "x.ndjson")).count() == 2 and [r.line for r in corrupt(spark, str(tmp_path / "x.ndjson")).collect()] == ["broken"]
    (tmp_path / "x.xml").write_text('<L><Event><EventID q="7">1</EventID><HostName>h</HostName></Event><Event><EventID q="8">2</EventID></Event></L>')
    assert [r.raw for r in read_raw(spark, str(tmp_path / "x.xml")).orderBy("seq").collect()] == [{"EventID": "1", "EventID_q": "7", "HostName": "h"}, {"EventID": "2", "EventID_q": "8"}]


def test_json_by_byte_ranges(spark, tmp_path):
    """Files cut into many byte ranges give the records of json.loads, in order."""
    import json
    import random

    from threatlake.sources import readers

    rng = random.Random(8)
    texts = ["", "a", 'quote " and \\ back', "{[", "}]", '\\"}', "é" * 7, "x" * 90, "\n{", "records"]

    def value(depth):
        kind = rng.randint(0, 5 if depth < 3 else 2)
        return rng.choice(texts) if kind < 2 else rng.randint(0, 99) if kind == 2 else [value(depth + 1) for _ in range(rng.randint(0, 3))] if kind == 3 else {rng.choice(texts) + str(i): value(depth + 1) for i in range(rng.randint(0, 3))}

    def record(i):
        return {"id": i + 1, "v": value(0), "w": value(1)}

    many = [record(i) for i in range(16)]
    mixed = [5, "a } b", *many[:5], [1, "{", [2]], None, *many[5:]]
    files = {
        "array": json.dumps(many), "pretty": json.dumps(many, indent=2, ensure_ascii=False) + "\n", "lines": "\n".join(map(json.dumps, many)), "run": "".join(json.dumps(r, indent=1) for r in many),
        "wrapper": json.dumps({"records": many, "other": [{"no": 1}], "more": {"x": [{}]}}), "late": json.dumps({"meta": {"a": [1]}, "events": many}), "mixed": json.dumps(mixed, ensure_ascii=False),
        "one": json.dumps(many[0]), "empty": "[]", "nothing": "", "bom": "\ufeff" + json.dumps(many), "long": json.dumps([{"id": 1, "v": "y" * 1_200}, {"id": 2}]), "cut": json.dumps(many)[:-5], "open": '{"id": 1',
    }
    for name, text in files.items():
        (tmp_path / f"{name}.json").write_text(text)
    want = {n: [readers._texts(r) for r in readers.records(t)] for n, t in files.items()}
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (old, "300b"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1b" if size != old else "4m")
            found = read_raw(spark, str(tmp_path), "json").collect()
            got = {n: [] for n in files}
            for r in sorted(found, key=lambda r: r.seq):
                got[r._src.rsplit("/", 1)[-1][:-5]].append(r.raw)
            for n in files:
                assert got[n] == want[n], (n, size, len(got[n]), len(want[n]))
            keys = [(r._src, r.seq) for r in found]
            assert len(set(keys)) == len(keys)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_truth_by_json_type(spark, tmp_path):
    """0, false, null, "", [] and {} are missing, "0" and "false" are not; large numbers and dotted names stay."""
    import json

    from threatlake.sources import readers

    rows = [
        {"a": 0, "b": "0", "c": False, "d": "false", "e": [], "f": {}, "g": "", "h": None, "i": "-", "host.name": "h"}, {"a": 0.0, "b": [0], "c": {"x": 0}, "d": True, "e": 12345678901234567890123, "f": -1, "g": " "},
        {"long": "x" * 100}, {},
    ]
    (tmp_path / "x.ndjson").write_text("\n".join([*map(json.dumps, rows), '{"a": 1, "a": 2}', "[1]", "broken"]))
    got = [r.raw for r in read_raw(spark, str(tmp_path / "x.ndjson")).orderBy("seq").collect()]
    plain = [readers._texts(r) for r in rows]
    assert [{k: json.dumps(json.loads(v)) if v[0] in "[{" else v for k, v in g.items()} for g in got[:4]] == plain and got[4] == {"a": "2"} and len(got) == 5
