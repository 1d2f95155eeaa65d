import hashlib
import re

from arcwise.llm.catalog import op6_secret_lexer
from arcwise.llm.secrets import lexed_spans, secret_spans
from tests.llm.common import FOLDER, docs_of, needs_tables


def brute_base(text):
    """By hand: scan for each kind at every place."""
    spans = []
    key = re.compile(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""")
    for kind, pattern, keep in (("assign", key, lambda m: len(m[1]) >= 6), ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
                                ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24)):
        at = 0
        while found := pattern.search(text, at):
            at = found.end()
            if keep(found):
                spans.append((found.start(), ("assign", "access", "hex").index(kind), found.end(), kind))
    return [f"{kind}:{a}:{b}" for a, _, b, kind in sorted(spans)]


def check(result, rows):
    texts = dict(rows)
    for row in result.collect():
        base = brute_base(texts[row.doc_id] or "")
        assert row.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(row.spans.split(",")) or not base
        for kind in ("assign", "access", "hex"):
            assert row[f"n_{kind}"] == sum(one.startswith(kind) for one in base)


@needs_tables
def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    result = op6_secret_lexer(spark, FOLDER)
    assert result.count() == len(rows)
    check(result, rows)


def test_edges(spark, tmp_path):
    rows = [(1, None), (2, ""), (3, "é password=abcdef x"), (4, "Password: 'abc' token=abc123=token=zzzzzz9"), (5, "AKIA" + "A" * 15 + " AKIA" + "B" * 16),
            (6, "0" * 24 + "g" + "f" * 23), (7, "x" * 300_000 + " api_key = 'a.b-c_d'"), (8, "tokeN passwd\t=\tabcdefg ſecret=abcdef")]
    path = tmp_path / "in"
    path.mkdir()
    docs = docs_of(spark, path, rows)
    assert {r.doc_id: r.joined for r in secret_spans(docs).collect()}[3] == "assign:2:17"
    spans = {r.doc_id: r.spans for r in secret_spans(docs).collect()}
    assert [s.value for s in spans[5]] == ["AKIA" + "B" * 16]
    assert [s.kind for s in spans[6]] == ["hex"]
    assert secret_spans(docs_of(spark, path, [])).count() == 0


def lexed(text):
    return [text[a:b] for a, b in lexed_spans(text)]


def test_lexer_reads_pairs_and_follows_names():
    assert lexed('db_pwd = "hunter22x"') == ["hunter22x"]
    assert lexed('default = "Zx81-q9Pz"\nclient_secret = default\n') == ["Zx81-q9Pz"]
    assert lexed('a = "Zx81-q9Pz"\nb = a\nauth_token: b') == ["Zx81-q9Pz"]
    assert lexed('{"privateKey": "MIIB8x+/0aa1", "colour": "MIIB8x+/0aa2"}') == ["MIIB8x+/0aa1"]
    assert lexed('a = b\nb = a\npassword = a') == []
    assert lexed('password = "changeme"\nname = "abc123def"\nsecret = os.environ') == []
    assert lexed("they said: token ring is: a network") == []
    assert lexed('x = "Old1secret9"\nx = "other"\npwd = x') == []
    long = "q7Z-" * 400
    assert lexed(f'auth_token: "{long}"') == lexed(f"auth_token = {long}") == lexed("n" * 300 + f"_token = '{long}'") == [long]
    assert lexed("--client-secret=Zx81-q9Pz") == ["Zx81-q9Pz"]


def test_long_runs_take_one_pass():
    assert lexed("a-" * 200_000) == lexed('x="' + "y" * 300_000) == lexed("a." * 200_000 + "=") == []


def test_lexer_reads_aligned_typed_and_referred_forms():
    forms = [
        'db_pwd            =          "S3cr3tVal9"', "db_pwd" + "\t" * 5000 + ":" + " " * 5000 + "S3cr3tVal9",
        'api_secret: str = "S3cr3tVal9"', 'const dbPwd: string = "S3cr3tVal9";', "let authToken: &'static str = \"S3cr3tVal9\";",
        'db_pwd: Optional[Dict[str, List[str]]] = "S3cr3tVal9"', 'db_pwd: str | None = "S3cr3tVal9"', 'val dbPwd: String? = "S3cr3tVal9"',
        'db_pwd: Final[str] = "S3cr3tVal9"', 'static dbPwd: std::string="S3cr3tVal9"', 'config: db_pwd = "S3cr3tVal9"',
        "BASE=S3cr3tVal9\nDB_PWD=$BASE", 'BASE="S3cr3tVal9"\nDB_PWD="${BASE}"', "BASE=S3cr3tVal9\nexport DB_PWD=${BASE}",
        'db_pwd = base\nbase = "S3cr3tVal9"', "DB_PWD=$A\nA=${B}\nB='S3cr3tVal9'", 'db_pwd: str = base\nbase: str = "S3cr3tVal9"',
    ]
    assert [lexed(form) for form in forms] == [["S3cr3tVal9"]] * len(forms)
    assert lexed('x = "Old1secret9"\npwd = x\nx = "other"') == ["Old1secret9"]
    for text in ("DB_PWD=$A\nA=$B\nB=$A", "DB_PWD=$DB_PWD", "DB_PWD=${NONE}", 'db_pwd: str\nname: str = "S3cr3tVal9"'):
        assert lexed(text) == []
    chain = "\n".join(f"n{k} = n{k + 1}" for k in range(50_000))
    assert lexed("pwd = n0\n" + chain + '\nn50000 = "S3cr3tVal9"') == ["S3cr3tVal9"]


def test_long_types_and_blanks_take_one_pass():
    for text in ("a: b[" * 100_000, "a: b | " * 100_000, "a: b<c, " * 100_000, "a" + " " * 300_000, ("a" + " " * 9) * 30_000, "a: b::" * 100_000):
        assert lexed(text) == []
