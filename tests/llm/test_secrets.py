import hashlib
import re

from noticeflow.llm import secrets

ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
RANDOM = "q8Zr2LmX0pWv7KdT4sYb9NcF1hGj"
TEXTS = [
    'é漢 token = "a084c530da0e77a3dafc1ad8c55a414de4243423" end',
    "PassWord:abcdef secret=short Api_Key='x.y-z_1+2/3='", "token=secret=abcdefg", 'password=token:"abcdefgh"',
    "password : key", "AKIA" + "A1" * 8, "AKIA" + "A1" * 7 + "x", "xAKIAAKIA" + "Z9" * 9, "g" + "0f" * 12 + "G", "0f" * 11,
    f"the signing key for staging is {RANDOM} and more", f"the colour of it is {RANDOM} and more",
    "the access token is example_key_1234567890abcdef0123456789abcdef as ever",
    None, "", "ſecret = abcdefgh", "toKen = abcdefgh", f"token {RANDOM} " * 3, "x" * 200_000 + " token=abcdef1"]


def base(text):
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


def test_spans(spark):
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], "s")],
                                 "doc_id long, text string, spans string")
    got = secrets.digest(secrets.scan(docs)).collect()
    assert len(got) == len(TEXTS) + 1
    for r in got:
        want = base(r["text"] or "")
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [
            sum(k == x for k, _, _ in want) for x in ("assign", "access", "hex")]
        spans = [s for s in r["spans"].split(",") if s]
        assert [s for s in spans if not s.startswith("novel")] == listed.split(",") * bool(listed)
    novel = {r["doc_id"]: "novel" in r["spans"] for r in got}
    assert novel[10] and not novel[11] and not novel[12]


def test_novelty_tells_noise_from_copies():
    novelty = secrets.Novelty(secrets.IDENTIFIERS)
    text = f"token {RANDOM} and some text"
    assert novelty(text, 6, 6 + len(RANDOM)) > 0.8
    again = f"token {RANDOM} and {RANDOM} again"
    assert novelty(again, 6, 6 + len(RANDOM)) < 0.4


def test_redaction_leaves_no_secret(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in secrets.redact(docs).collect()}
    assert out[0] == 'é漢 token = "[redacted]" end' and out[11] == TEXTS[11] and out[13] is None
    assert all(not base(t or "") for t in out.values())
    assert secrets.redact(docs.where("false")).collect() == []
