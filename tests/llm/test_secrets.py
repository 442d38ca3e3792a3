import re

from tallyweave.llm import secrets

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
KEY, HEX = "AKIA" + "B" * 16, "deadbeef" * 4


def brute(text):
    text = text or ""
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(found)


TEXTS = [
    f"Password = 'abcdefghijkl' and {KEY}{HEX}", "secret: password: averylongsecretvalue", "token=token=abcdefghijklmnop", f"é\U0001f600 api_key={HEX}",
    "APIKEY : short", f"AKIAAKIA{'A' * 14} {'f' * 15} {'0' * 16}", "", None, f"x{HEX}" * 40, "password:" + " " * 3000 + "abcdefghijklmnop",
]


def listed(df):
    return sorted(((r.doc_id, [(s.start, s.place, s.kind, s.end) for s in r.found]) for r in df.collect()), key=repr)


def test_spans_match_a_scan_in_python(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS * 2)], "doc_id long, text string")
    assert listed(secrets.scan_documents(docs)) == sorted(((i, brute(t)) for i, t in enumerate(TEXTS * 2)), key=repr)


def test_odd_rows(odd_docs):
    want = sorted(((r.doc_id, brute(r.text)) for r in odd_docs.collect()), key=repr)
    assert listed(secrets.scan_documents(odd_docs)) == want


def test_empty_table(no_docs):
    assert secrets.scan_documents(no_docs).collect() == []


def test_only_unseen_pairs_are_scanned(spark, tmp_path):
    folder = str(tmp_path / "ledger")
    first = spark.createDataFrame([(1, TEXTS[0]), (2, TEXTS[0]), (3, TEXTS[1])], "path long, text string")
    secrets.scan_new(first, folder)
    assert secrets.read_ledger(spark, folder).count() == 2 * len(secrets.RULES)
    secrets.scan_new(first, folder)
    assert secrets.read_ledger(spark, folder).count() == 2 * len(secrets.RULES)
    changed = (*secrets.RULES[:2], secrets.Rule("hex", "[0-9a-f]{8,}", 0, 8, version=2))
    second = spark.createDataFrame([(1, TEXTS[0]), (4, "new text")], "path long, text string")
    addresses = secrets.scan_new(second, folder, changed)
    assert secrets.read_ledger(spark, folder).count() == 2 * 3 + 1 + 3
    assert {r.path: len(r.found) for r in secrets.findings(addresses, folder, changed).collect()} == {1: 3, 4: 0}


def test_every_path_of_a_blob_gets_its_findings(spark):
    docs = spark.createDataFrame([(i, TEXTS[0]) for i in range(50)], "doc_id long, text string")
    assert {len(f) for _, f in listed(secrets.scan_documents(docs))} == {3}
