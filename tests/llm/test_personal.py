import pytest

from tessera.llm import personal as P


@pytest.fixture(scope="module")
def model():
    return P.model()


def test_held_out_sentences(model):
    right = wrong = missed = 0
    for text, spans in P.made_up(400, seed=99):
        got, want = set(model.decode(text)), set(spans)
        right, wrong, missed = right + len(got & want), wrong + len(got - want), missed + len(want - got)
    assert right / (right + wrong) > 0.93 and right / (right + missed) > 0.93


CASES = [
    ("My address is ann.lee@mail.example, call me on +44 20 7946 0123.", {"email", "phone"}),
    ("write to ann.lee (at) mail (dot) example if the sync fails", {"email"}),
    ("身份证号991017196108196995，我住在云麓市青禾区石榴路302号6栋1545室", {"id_number", "address"}),
    ("I live at 24 Wrensdale Ave, Apt 6A, Brindle Hollow 00646", {"address"}),
    ("The form lists SSN 987-65-4321 and cc Talia Norwyck when the import ends", {"id_number", "person"}),
    ("记录人是祁望舒。", {"person"}),
    ("see ticket 720-28309 from 2024-06-16", set()),
    ("build 9.829.9 runs on 10.0.9.9, the trace id is 916449164491644", set()),
    ("use the @app.post decorator on line 898; the package is @vault/core-6", set()),
    ("Granite Pass is the release after Silver Birch 8. 端口 15912 保持打开。第349号规则不变。", set()),
    ("", set()),
]


@pytest.mark.parametrize(("text", "kinds"), CASES)
def test_cases(model, text, kinds):
    assert {k for *_, k in model.decode(text)} == kinds


@pytest.mark.parametrize("name", ["傅明远", "常春梅", "施文博", "赖建国", "殷秋", "樊若笙", "欧阳明远", "司马清", "诸葛云舒", "上官婉", "张王丽华"])
def test_chinese_names_of_every_family_name(model, name):
    """A name is a candidate as a whole, and found as one after a cue."""
    text = f"记录人是{name}。"
    assert (4, 4 + len(name), "person") in {c[:3] for c in P.candidates(text)}
    assert model.decode(text) == [(4, 4 + len(name), "person")]


def test_spans_are_disjoint_and_redaction_keeps_the_rest(model):
    for text, _ in P.made_up(100, seed=5):
        spans = model.decode(text)
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))
        kept = "".join(text[a:b] for a, b in zip([0, *[s[1] for s in spans]], [*[s[0] for s in spans], len(text)], strict=True))
        out = P.redact(text, spans)
        for k in P.KINDS:
            out = out.replace(f"[{k.upper()}]", "")
        assert out == kept


def test_decoding_is_the_best_of_all_disjoint_sets(model):
    tried = 0
    for text, _ in P.made_up(120, seed=8):
        segments = [(s, e, k, model.score(f)) for s, e, k, f in model.lattice(text)]
        if not 1 < len(segments) <= 12:
            continue
        tried += 1
        best = 0.0
        for mask in range(1 << len(segments)):
            own = sorted(x for i, x in enumerate(segments) if mask >> i & 1)
            if all(a[1] <= b[0] for a, b in zip(own, own[1:], strict=False)):
                best = max(best, sum(x[3] for x in own))
        got = set(model.decode(text))
        assert sum(v for s, e, k, v in segments if (s, e, k) in got) == pytest.approx(best, abs=1e-6)
    assert tried > 20


def test_tables(spark):
    m = spark.createDataFrame([("1", "my address is a.b@mail.example", None, "v"), ("1", "my address is a.b@mail.example", None, "v"), (None, "", "", "v"), ("2", None, "tel 415-555-0137", "v")], "id string, statement string, quote string, value string")
    c = spark.createDataFrame([("m", "x" * 20000 + " ID no. 987-65-4324 is on page two", "spans")], "message_id string, content string, spans string")
    got = {tuple(r) for r in P.found(spark, m, c).collect()}
    assert got == {("memories", "1", "statement", "email"), ("memories", "2", "quote", "phone"), ("conversation_messages", "m", "content", "id_number")}
    whole = {(r["row_id"], r["field"]): r["value"] for r in P.find(spark, P.values_of(m, c)).collect()}
    assert whole["1", "statement"] == "my address is [EMAIL]" and whole["1", "quote"] is None and whole[None, "quote"] == ""
    assert P.found(spark, m.limit(0), c.limit(0)).count() == 0


#: Written by hand, in no template of the training data.
FOREIGN = [
    ("Could you contact Jean-Luc Picard before Friday?", ["Jean-Luc Picard"]),
    ("Pieter van der Berg wrote this page in spring.", ["Pieter van der Berg"]),
    ("Reply to s.okafor@mail.example or ring 020 7946 0123.", ["s.okafor@mail.example", "020 7946 0123"]),
    ("Our dentist jane morrow moved to 14 Harbour Road, Oldtown.", ["jane morrow", "14 Harbour Road, Oldtown"]),
    ("Letters go to P.O. Box 123, Oldtown from now on.", ["P.O. Box 123, Oldtown"]),
    ("Письмо для Анны Смирновой лежит на столе.", ["Анны Смирновой"]),
    ("Please ask Maria de la Cruz whether the vault syncs.", ["Maria de la Cruz"]),
    ("请把周报发给王小明，他的手机号是13912345678。", ["王小明", "13912345678"]),
    ("The release notes mention 300 pages and version 2.14.0.", []),
    ("My sister uses the old index every day.", []),
    ("Ticket 4711-20938 was closed on 2024-05-06.", []),
    ("The manager is happy with the new export.", []),
    ("在第三章里我们讨论了索引的结构。", []),
]


def test_sentences_of_no_template():
    m = P.model()
    hit = wrong = wanted = 0
    for text, own in FOREIGN:
        got = [text[s:e] for s, e, _ in m.decode(text)]
        hit, wrong, wanted = hit + len(set(got) & set(own)), wrong + len(set(got) - set(own)), wanted + len(own)
    assert hit / wanted >= 0.8 and hit / (hit + wrong) >= 0.8, (hit, wrong, wanted)


def test_last_token():
    assert [P.last_token(x) for x in ("", "  ", "a B", "x 12 ", "见张三", "三", "ok,", "é", "a_")] == ["^", "^", "b", "12", "张三", "三", ",", "^", "^"]
