"""The secret scan: syntaxes, constants, clean texts, and the whole query against plain patterns."""

import hashlib
import re
import time

import pytest

from webgrain.llm import secrets

KEY = "Zx81Qm44Lp07Tt53"
FOUND = {
    f'cfg["client_secret"] = "{KEY}"': [KEY],
    f"$h{{password}} = '{KEY}'": [KEY],
    f'const signingKey: string = "{KEY}";': [KEY],
    f'var key string = "{KEY}aB"': [KEY + "aB"],
    f'char secret_key[] = "{KEY}";': [KEY],
    f'#define SECRET_KEY "{KEY}"': [KEY],
    f"export SECRET_KEY={KEY}": [KEY],
    f"run --secret-key {KEY} now": [KEY],
    f"run --secret-key={KEY} now": [KEY],
    f'set("auth_key", "{KEY}")': [KEY],
    f'connect(user="bob12xY", password="{KEY}")': [KEY],
    f"<password>{KEY}</password>": [KEY],
    f'<add key="ApiSecret" value="{KEY}"/>': [KEY],
    f"credentials:\n  user:\n    value: {KEY}\nother: {KEY}2": [KEY],
    f"- name: DB_PASSWORD\n  value: {KEY}\n- name: OTHER\n  value: {KEY}2": [KEY],
    f'{{"credentials": {{"data": "{KEY}"}}, "x": "{KEY}2"}}': [KEY],
    f"[credentials]\nvalue = {KEY}\n[other]\nvalue = {KEY}2": [KEY],
    f'secret = """{KEY}"""': [KEY],
    "private_key: |\n  -----BEGIN KEY-----\n  MIIEvQIBADANBg9\n  kqhkiG9w0BAQEFA\n  -----END KEY-----\nnext: A1b2C3d4E5": ["MIIEvQIBADANBg9", "kqhkiG9w0BAQEFA"],
    r'"private_key": "-----BEGIN KEY-----\nMIIEvQIBADANBg9\n-----END KEY-----\n"': ["MIIEvQIBADANBg9"],
    f"password = later\nlater = '{KEY}'": [KEY],
    f'self.key = "{KEY}"\nclient_secret = self.key': [KEY],
    f'A_VALUE = "{KEY}"\nmode = "fast"\npassword = os.environ["A_VALUE"]': [KEY],
    "A = 'Zx81Qm44'\nB = 'Lp07Tt53'\nsecret = f\"{A}{B}\"": ["Zx81Qm44", "Lp07Tt53"],
    'secret_key = "Zx81Qm44" + "Lp07Tt53"': ["Zx81Qm44", "Lp07Tt53"],
    'secret = (\n  "Zx81Qm44"\n  "Lp07Tt53"\n)': ["Zx81Qm44", "Lp07Tt53"],
    'pw = "q7"; pw += "Zx81Qm44"; db_password = pw': ["q7", "Zx81Qm44"],
    f'cfg = "{{\\"client_secret\\": \\"{KEY}\\"}}"': [KEY],
    f"env: AWS_SECRET_ACCESS_KEY={KEY}": [KEY],
    f'cmd = "CLIENT_PRIVATE_KEY={KEY}"': [KEY],
    f"Authorization: Bearer eyJhbGciOi1.{KEY}": [f"eyJhbGciOi1.{KEY}"],
    "\n".join([f'k0 = "{KEY}"', *(f"k{i} = k{i - 1}" for i in range(1, 50)), "secret = k49"]): [KEY],
    f"{'x' * 300}_password = '{KEY}'": [KEY],
    "db_password = 'q7$xZ'": ["q7$xZ"],
    f'cfg.setSigningKey("{KEY}")': [KEY],
    f"client->set_password('{KEY}');": [KEY],
    f'K = "{KEY}"\nbuilder.withSecret(K)': [KEY],
    f'signingKey = prod ? "{KEY}" : "{KEY}9"': [KEY, KEY + "9"],
    f'signingKey = env == "prod" ? "{KEY}" : "dev"': [KEY],
    f'signing_key = "{KEY}" if prod else "dev"': [KEY],
    f'a = p ? "{KEY}" : q ? "{KEY}8" : "plain"\nclient_secret = a': [KEY, KEY + "8"],
    f'auth_key := getenv("X12aB") || "{KEY}"': [KEY],
    f'auth_key = os.environ.get("X12aB") or "{KEY}"': [KEY],
    f'authKey = process.env.X ?? "{KEY}"': [KEY],
    f'password = config.get("X12aB", "{KEY}")': [KEY],
    f'user, client_credential = "bob", "{KEY}"': [KEY],
    f'const [user, authKey] = ["bob12xY", "{KEY}"];': [KEY],
    f'(a, b) = ("x", "{KEY}")\nsecret = b': [KEY],
    f'K = "{KEY}"\nprivate_key = "%s" % K': [KEY],
    f'K = "{KEY}"\nprivate_key = "{{}}".format(K)': [KEY],
    f'K = "{KEY}"\nprivateKey := fmt.Sprintf("%s", K)': [KEY],
    'secret = "".join(["Zx81Qm44", "Lp07Tt53"])': ["Zx81Qm44", "Lp07Tt53"],
    'secret = ["Zx81Qm44", "Lp07Tt53"].join("")': ["Zx81Qm44", "Lp07Tt53"],
    f'if auth_key == "{KEY}": go()': [KEY],
    f'if ("{KEY}" === authKey) go()': [KEY],
    f'if (authKey.equals("{KEY}")) go()': [KEY],
    'token = "839201746553"': ["839201746553"],
    'client_secret = "qzxvwkjhptrnmbgd"': ["qzxvwkjhptrnmbgd"],
    'passphrase = "correct horse battery staple"': ["correct horse battery staple"],
    'db_password = "q7x Zx81 kk9"': ["q7x Zx81 kk9"],
    f"see https://user:{KEY}@host/path": [KEY],
}
CLEAN = [
    'The token: Something. His password: required. Key: Value. See "Session: Monday" at 12:30, it\'s a key.',
    f"public_key: {KEY}",
    f'label = "{KEY}"\nclient_secret = other',
    "password = os.environ['DB_PASSWORD']",
    'tokenizer = "Bert5cased-v2X"',
    "password: userPassword",
    "a = b\nb = a\npassword = a",
    f'a = "{KEY}"\na = "public words"\npassword = a',
    'auth_key := getenv("X12aB")',
    "the private key: Always2try",
    "token = getToken2X()",
    "def set_password(self, newPassword2): pass",
    'passphrase = "enter your new passphrase here"',
    'password = "Must be 8 characters"',
    "see https://user:password@host and https://user:${PASSWORD2}@host",
    'signingKey = prod ? "first" : "second"',
    'if color == "Zx81Qm44Lp07Tt53": go()',
    'password = "administrator"; token = "2024"',
]


@pytest.mark.parametrize("text", FOUND)
def test_syntaxes(text):
    for lead in ("", "é 'tis so.\n"):
        spans = sorted(secrets.named_spans(lead + text))
        assert [(lead + text)[a:b] for a, _, b in spans] == FOUND[text]


@pytest.mark.parametrize("text", CLEAN)
def test_clean_texts(text):
    assert secrets.named_spans(text) == []


def test_time_is_linear():
    n = 20_000
    hostile = ["key=" * n, 'password = "' + 'x\\"' * n, "it's key: 'a " * n, "<key " * n, "key: {" * n, '"""' * n + "key", '\\"' * n + "key", "key = " + "+".join(["k"] * n), "key:" * n, "key" * n, "(" * n + "key=" + "(" * n]
    hostile += [x * n for x in ("key=[", 'key="%s"%(key,', 'key="".join([', "key=concat(", "key=a ? a : ", "a,key=", "key=a if a else ", "key.set_key(", "key=='a'", "://a:key", "key=a or ")]
    doubled = "\n".join(['x0 = "aB1"', *(f"x{i} = x{i - 1} + x{i - 1}" for i in range(1, 500)), "secret = x499"])
    begin = time.time()
    for text in [*hostile, doubled]:
        secrets.named_spans(text)
    assert time.time() - begin < 30


def test_query_against_plain_patterns(spark, tmp_path):
    """Every span of the whole query, where all assignments have one shape: name, operator and literal on a line."""
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    rows += [(10_000 + i, f'{name} = "{KEY}{i}" é\n{name}: {KEY}{i}\n') for i, name in enumerate(["token", "my_secret", "color", "public_key", "dbPassword"])] + [(None, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["spans"] for r in secrets.op10(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    pair = re.compile(r"([A-Za-z_]+) ?[=:] ?\"?([^\s\"]+)")
    named = 0
    for i, text in rows:
        want = secrets.base_spans(text or "")
        for m in pair.finditer(text or ""):
            value = m[2].rstrip(".,;:!?")
            kinds = sum(any(f(c) for c in value) for f in (str.isdigit, str.islower, str.isupper))
            if kinds >= 2 and any(c.isdigit() for c in value) and re.search("token|secret|password", m[1].lower()):
                want.append((m.start(2), 3, m.start(2) + len(value)))
                named += 1
        assert got[i] == secrets.joined(want), i
    assert named > 12


SHAPES = [
    'cfg.set{0}("{1}")',
    '{0} = prod ? "{1}" : "{2}"',
    'user, {0} = "bob", "{1}"',
    'if {0} == "{1}": go()',
    '{0} = lookup("{2}") or "{1}"',
]
#: The literals that the shapes bind, found without a lexer.
PLAIN_SHAPES = [
    re.compile(r'cfg\.set(?P<name>\w+)\("(?P<a>\w+)"\)'),
    re.compile(r'(?P<name>\w+) = prod \? "(?P<a>\w+)" : "(?P<b>\w+)"'),
    re.compile(r'user, (?P<name>\w+) = "bob", "(?P<a>\w+)"'),
    re.compile(r'if (?P<name>\w+) == "(?P<a>\w+)": go\(\)'),
    re.compile(r'(?P<name>\w+) = lookup\("\w+"\) or "(?P<a>\w+)"'),
]


def test_query_against_plain_shapes(spark, tmp_path):
    """Each document with a line of one shape after it: exactly the literals that its expression finds are marked more."""
    docs = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    rows = []
    for i, text in docs:
        digest = hashlib.sha256(str(i).encode()).hexdigest()
        name = ("ClientSecret", "Color", "DbPassword", "PublicKey", "LabelText")[i % 7 % 5]
        values = [f"Q{digest[:15]}7x", f"w{digest[20:34]}K8"] if i % 3 else ["settings", f"Q{digest[:15]}7x"]
        rows.append((i, text, "\n" + SHAPES[i % 5].format(name, *values) + "\n"))
    whole = spark.createDataFrame([(i, a + b) for i, a, b in rows], "doc_id long, text string")
    whole.write.parquet(f"{tmp_path}/with/documents.parquet")
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/without/documents.parquet")
    spans = lambda d: {r["doc_id"]: set(r["spans"].split(",")) - {""} for r in secrets.op10(spark, f"{tmp_path}/{d}").collect()}
    before, after = spans("without"), spans("with")
    marked = 0
    for i, text, line in rows:
        m = PLAIN_SHAPES[i % 5].search(line)
        base = {f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in secrets.base_spans(text + line)}
        want = {x for x in before[i] if x.startswith("named")} | base
        if re.search("secret|password", m["name"], re.I):
            for group, value in m.groupdict().items():
                if group != "name" and value and any(c.isdigit() for c in value):
                    want.add(f"named:{len(text) + m.start(group)}:{len(text) + m.end(group)}")
                    marked += 1
        assert after[i] == want, (i, line)
    assert marked > 200
