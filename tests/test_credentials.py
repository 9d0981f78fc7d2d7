import pytest

from maskwright.operators.credentials import with_credentials

# text with the expected spans between « and »
CASES = {
    "short values": "«passwd=\"blue river stone\"»; «secret=k9x»; «Token: q7»",
    "json": "{«\"password\": \"two words\"», «\"api_key\": \"x1\"»}",
    "escaped quotes": "{«\"client_secret\": \"a \\\"b\\\" c\"»}",
    "single quotes": "see «'passwd' = 'it is'» here",
    "several lines": "«token=\"first\nsecond\"»\nnext",
    "unfinished": "a «token='never closed, at all»\nnext line",
    "prefixed": "«my-access_token: abc» and «X-API-KEY=z»",
    "literal block": "conf:\n«password: |\n  one\n\n  two»\n\nnote: keep",
    "folded block": "«token: >-2\n   one\n   two»\nnote: keep",
    "list item": "- «password: |\n    one»\n- note: keep",
    "quoted block": "> «password: |\n>   one\n>   two»\n> note: keep",
    "nested quoted block": ">>  «'token': |\r\n>>     one\r\n>>\r\n>>     two»\r\n>>  note: keep",
    "leaving the quotation": "> «password: |\n>   one»\n  note: keep",
    "inner quote sign": "> «password: |\n>   > one»\n> note: keep",
    "lone cr block": "«password: |\r  one\r  two»\rnote: keep",
    "header": "«Authorization: Basic some words»\nnote",
    "header case": "  «pRoXy-AuThOrIzAtIoN:\tx y»\n  Accept: text/plain",
    "header continued": "«Cookie: a=b\n  c=d\n\te=f»\nAccept: x",
    "header starting below": "«Set-Cookie:\n a=b»\nAccept: x",
    "quoted header": "> > «Cookie: a=b\r\n> >  c=d»\r\n> > Accept: x",
    "blank line ends": "«Cookie: a=b»\n\n  text",
    "after emoji": "😀\r«Authorization: Bearer x»\rrest",
    "private key": "x «-----BEGIN RSA PRIVATE KEY-----\nabc\n-----END RSA PRIVATE KEY-----» y",
    "shaped": "use «sk-abcdefghijklmnopqrstuv» now",
    "no value": "token:\n",
    "empty block": "password: |\n\nnote: keep",
    "empty block at end": "token: >",
    "empty quotes": "password=\"\", b",
    "negative names": "{\"password_reset\": true, \"token_count\": 12, \"secret_size\": 0}",
    "negative prose": "Please reset the password. Never share a token here.",
    "negative headers": "Authorization-Status: none\nX-Cookie: y\nWWW-Authenticate: Bearer realm=\"x\"\nThe Cookie: header",
    "empty header": "Authorization:\nAccept: x",
}


@pytest.fixture(scope="module")
def found(spark):
    plain = {name: text.replace("«", "").replace("»", "") for name, text in CASES.items()}
    df = spark.createDataFrame(list(plain.items()), "name string, text string")
    return {r.name: [r.text[s.start : s.end] for s in r.credentials] for r in with_credentials(df).collect()}


@pytest.mark.parametrize("name", CASES)
def test_credential_ranges(found, name):
    expected = [part.split("»")[0] for part in CASES[name].split("«")[1:]]
    assert found[name] == expected


def test_long_values_neither_overflow_nor_stall(spark):
    text = "x" * 50_000 + ' password="' + '\\"' * 50_000 + '" ' + "-a" * 50_000 + " Cookie: " + "> " * 20_000
    df = spark.createDataFrame([(text,)], "text string")
    (row,) = with_credentials(df).collect()
    assert [(s.start, s.end) for s in row.credentials] == [(50_001, 150_012)]
