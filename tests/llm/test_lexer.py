"""The lexer by syntax: what it must find, and what it must leave alone."""

import time

import pytest

from arcwise.llm.lexer import lexed_spans

KEY = "S3cr3tVal9"

# Per syntax: texts whose one literal is a secret.
FOUND = {
    "python": [
        f'db_pwd = "{KEY}"', f"db_pwd = b'{KEY}'", f'db_pwd = f"{KEY}"', f"db_pwd = r'{KEY}'", f'db_pwd = ("{KEY}")',
        f'db_pwd = """{KEY}"""', f"db_pwd = '''{KEY}'''", f'x = os.getenv("DB_PWD", "{KEY}")', f'db_user, db_pwd = "bobby123", "{KEY}"',
        f'db_pwd = \\\n    "{KEY}"', f'db_pwd += "{KEY}"', f'db_pwd: str = "{KEY}"', f'a = db_pwd = "{KEY}"', f'db_pwd = a = "{KEY}"',
        f'connect(user="bob", db_pwd="{KEY}")', f'd["db_pwd"] = "{KEY}"', f'db_pwd = decode("{KEY}")', f'if (db_pwd := "{KEY}"): pass',
    ],
    "javascript": [
        f"const dbPwd = `{KEY}`;", f'const dbPwd: string = "{KEY}";', f"config = {{dbPwd: '{KEY}'}}", f'dbPwd ||= "{KEY}"', f'this.dbPwd = "{KEY}"',
    ],
    "php": [f"define('DB_PWD', '{KEY}');", f"$db_pwd = '{KEY}';", f"'db_pwd' => '{KEY}',"],
    "go": [f'dbPwd := "{KEY}"', f"dbPwd := `{KEY}`", f'os.Setenv("DB_PWD", "{KEY}")'],
    "java": [f'String dbPwd = "{KEY}";', f'props.setProperty("db.pwd", "{KEY}");', f'String dbPwd = new String("{KEY}");'],
    "env": [f"DB_PWD={KEY}", f"export DB_PWD={KEY}", f'DB_PWD="{KEY}"', f"ENV DB_PWD={KEY}", f"DB_PWD={KEY}#x!y"],
    "ini": [f"[db]\ndb_pwd = {KEY}", f"db_pwd: {KEY}"],
    "yaml": [f"db_pwd: {KEY}", f"db_pwd: |\n  {KEY}\n", f"db_pwd: >-\n    {KEY}", f"- name: DB_PWD\n  value: {KEY}", f'- name: DB_PWD\n  value: "{KEY}"'],
    "json": [f'{{"db_pwd": "{KEY}"}}', f'"{{\\"db_pwd\\": \\"{KEY}\\"}}"', f'{{"name": "DB_PWD", "value": "{KEY}"}}'],
    "xml": [f"<db_pwd>{KEY}</db_pwd>", f'<db pwd="{KEY}"/>', f'<add key="db_pwd" value="{KEY}"/>', f"<a:db_pwd x='1'> {KEY} </a:db_pwd>"],
    "command line": [f"run --db-pwd={KEY} now", f"run --db-pwd '{KEY}' --x=1".replace("-pwd '", "-pwd='")],
}

LEFT = {
    "python": ['db_pwd = ""', 'db_pwd = getpass("Enter your password 1")', "db_pwd = os.environ['DB_PWD']", 'if db_pwd == "S3cr3tVal9": pass', 'db_user, note = "S3cr3tVal9", "x1y2z3w4"'],
    "javascript": ["const dbPwd = `${process.env.PWD1}`", "const dbPwd = props.password"],
    "php": ["define('DB_HOST', 'S3cr3tVal9');", "$db_pwd = $_POST['x1'];"],
    "go": ['dbPwd := os.Getenv("DB_PWD")', 'name := "S3cr3tVal9"'],
    "java": ['String dbPwd = System.getenv("DB_PWD1");'],
    "env": ["DB_PWD=", "DB_PWD=$OTHER", "DB_PWD=changeme", "HOST=S3cr3tVal9"],
    "ini": ["db_pwd = ", "[db_pwd]\nx = S3cr3tVal9"],
    "yaml": ["db_pwd: |\nhost: S3cr3tVal9", "- name: HOST\n  value: S3cr3tVal9", "db_pwd: ${DB_PWD}"],
    "json": ['{"db_pwd": null}', '{"db_pwd": true, "host": "S3cr3tVal9"}', '{"name": "HOST", "value": "S3cr3tVal9"}'],
    "xml": ["<db_pwd></db_pwd>", "<host>S3cr3tVal9</host>", '<add key="host" value="S3cr3tVal9"/>'],
    "prose": ["The password: please ask your manager, as ever.", "It's a token, isn't it: a secret of 1900.", "Reset your password (twice) = trouble"],
}


def lexed(text):
    return [text[a:b] for a, b in lexed_spans(text)]


@pytest.mark.parametrize("syntax", FOUND)
def test_found_by_syntax(syntax):
    missed = [text for text in FOUND[syntax] if not (lexed(text) and all(one.startswith(KEY) for one in lexed(text)))]
    assert not missed


@pytest.mark.parametrize("syntax", LEFT)
def test_left_alone_by_syntax(syntax):
    wrong = [(text, lexed(text)) for text in LEFT[syntax] if lexed(text)]
    assert not wrong


def test_joined_values():
    assert lexed('db_pwd = "S3cr3t" + "Val9x7"') == ["S3cr3t", "Val9x7"]
    assert lexed('db_pwd = "S3c" "r3t" \'Val9\'') == ["S3c", "r3t", "Val9"]
    assert lexed('db_pwd = ("S3cr3t"\n          "Val9x7")') == ["S3cr3t", "Val9x7"]
    assert lexed('A = "S3c"\nB = "r3tVal9"\ndb_pwd = A + B') == ["S3c", "r3tVal9"]
    assert lexed("$a = 'r3tVal9';\n$db_pwd = 'S3c' . $a;") == ["r3tVal9", "S3c"]
    assert lexed('BASE="S3cr3t9"\nDB_PWD="pre-${BASE}"') == ["S3cr3t9", "pre-"]
    assert lexed('base = "S3cr3t9"\ndb_pwd = f"pre-{base}-x"') == ["S3cr3t9", "pre-", "-x"]
    assert lexed('db_pwd = "pa$$w0rdX9"') == ["pa$$w0rdX9"]


def test_passphrases():
    assert lexed('passphrase = "correct horse battery staple"') == ["correct horse battery staple"]
    assert lexed('db_password: "maple river 9 lantern"') == ["maple river 9 lantern"]
    assert lexed('password = "Please enter your password here"') == lexed('passphrase = "enter it"') == []


def test_joined_names_in_a_circle():
    assert lexed('a = b + "S3cr3tVal9"\nb = a + "x"\ndb_pwd = a') == ["S3cr3tVal9", "x"]


def test_long_texts_take_one_pass():
    begun = time.monotonic()
    for text in (
        "a, " * 100_000, "a = " * 100_000, "(" * 200_000, "( '" * 100_000, 'x = """' * 50_001, "x = `" * 50_001, "<a " * 100_000,
        'a="b" + ' * 50_000, "k: name: " * 50_000, "a: |\n" * 100_000, "\\\n" * 100_000, "export " * 50_000 + "A=b", 'n = """' + "q" * 300_000,
    ):
        assert lexed(text) == []
    assert time.monotonic() - begun < 30
