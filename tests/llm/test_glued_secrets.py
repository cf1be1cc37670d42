import random

from quillspan.llm import secret_scan

HEX = "0123456789abcdef0123456789abcdef"
FORMS = ["https://host.example/maps?key={}&v=3", "GITHUB_PAT={}", "https://host.example/path/{}", "name={}/walks.house", "mail.{}", HEX + "/{}"]


def keys():
    rng = random.Random(3)
    key = lambda head, n: head + "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=n))
    return [key(head, n) for _ in range(6) for head, n in (("AIza", 35), ("ghp_", 36), ("SG.", 66), ("npm_", 36))]


def test_glued_credentials_are_found_as_those_alone_are(spark):
    rng = random.Random(4)
    words = "the house of water runs under green light stone evening walks".split()
    plain = [" ".join(rng.choice("/_=.").join(rng.choices(words, k=4)) for _ in range(30)) for _ in range(200)]
    alone = keys()
    glued = [FORMS[k % len(FORMS)].format(key) for k, key in enumerate(alone)]
    both = [f"{alone[k]}/{alone[k + 1]}" for k in range(0, len(alone), 2)]
    texts = [f"see {t} there" for t in [*alone, *glued, *both]] + plain
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    spans = {r.doc_id: [x.split(":") for x in r.spans.split(",") if x] for r in secret_scan.find(df).collect()}
    clean = {r.doc_id: r.text for r in secret_scan.redact(df).collect()}
    found = lambda k: [texts[k][int(a) : int(z)] for kind, a, z in spans[k] if kind == "format"]
    n = len(alone)
    seen = [found(k) == [alone[k]] for k in range(n)]
    assert sum(seen) >= 6
    for k in range(n):
        assert all(any(s in f for f in found(n + k)) and s not in clean[n + k] for s in found(k)), texts[n + k]
    for k in range(0, n, 2):
        assert all(any(s in f for f in found(2 * n + k // 2)) for s in found(k) + found(k + 1))
    assert not any(spans[k] for k in range(2 * n + n // 2, len(texts)))
