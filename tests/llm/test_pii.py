import hashlib
import random
import re

import pytest
from millrace.llm import pii

BRUTE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= len(re.sub(r"\D", "", s)) <= 19 and pii.luhn(re.sub(r"\D", "", s))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(re.sub(r"\D", "", s)) <= 15),
}


def brute(text):
    found = [(m.start(), k, m.end()) for k, (p, ok) in enumerate(BRUTE.values()) for m in re.finditer(p, text) if ok(m[0])]
    return sorted(found)


@pytest.mark.parametrize("seed", range(40))
def test_base_spans_equal_the_plain_patterns(seed):
    r = random.Random(seed)
    bits = ["a@b.c", "@", ".", "1.2.3.4", "300.1.1.1", "+", "4111 1111 1111 1111", "4111-1111-1111-1112", " ", "x.y+z", "+1 (212) 555-0100", "é", "5", "-", "(", "00", "a-b@c-d.e-f", "%"]
    for _ in range(300):
        text = "".join(r.choice(bits) for _ in range(r.randint(0, 14)))
        assert [x[:3] for x in pii.spans(text) if x[1] < 4] == brute(text), text


def test_added_kinds_and_context():
    text = "My IBAN is GB82 WEST 1234 5698 7654 32 and ssn 123-45-6789, not GB82 WEST 1234 5698 7654 33"
    kinds = [pii.KINDS[k] for _, k, _, _ in pii.spans(text)]
    assert kinds.count("iban") == 1 and kinds.count("ssn") == 1
    assert not [x for x in pii.spans("code 123-45-6789 of a part") if pii.KINDS[x[1]] == "ssn"]
    near, far = pii.spans("call +1 212 555 0100")[0][3], pii.spans("xxxx +1 212 555 0100")[0][3]
    assert near > far


def test_long_runs_take_linear_time():
    for text in ("1" * 200_000, "a." * 100_000, "1." * 100_000, "+1" + "(" * 200_000, "@a" * 100_000, "a@" * 100_000):
        pii.spans(text)


def test_rows_nulls_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a@b.co é 1.2.3.4", 5), (2, None, 5), (None, "", 5), (1, "a@b.co é 1.2.3.4", 5)], "doc_id long, text string, spans int")
    rows = pii.find_pii(docs).collect()
    assert sorted((r.doc_id or 0, r.n_email, r.n_ip, r.spans) for r in rows) == [(0, 0, 0, ""), (1, 1, 1, "email:0:6,ip:9:16"), (1, 1, 1, "email:0:6,ip:9:16"), (2, 0, 0, "")]
    assert {r.base_sha256 for r in rows if r.doc_id == 2} == {hashlib.sha256(b"").hexdigest()}
    assert pii.find_pii(docs.limit(0)).count() == 0


def test_a_failing_iban_hides_no_valid_one():
    text = "REF AB12 GB82 WEST 1234 5698 7654 32 and GB82 WEST 1234 5698 7654 32 GB82 WEST 1234 5698 7654 32"
    found = [text[a:b] for a, b in pii.ibans(text)]
    assert found == ["GB82 WEST 1234 5698 7654 32"] * 3
