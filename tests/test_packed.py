import json
import random

import pyarrow as pa
from rotativa.operators.packed import explode_packed, split_cells


def split(*cells):
    p, v = split_cells(pa.array(cells, pa.string()))
    out = [[] for _ in cells]
    for i, x in zip(p.to_pylist(), v.to_pylist()):
        out[i].append(x)
    return out if len(cells) > 1 else out[0]


def test_delimiters():
    assert split("a|b | c") == ["a", "b", "c"]
    assert split("uno, S.A. de C.V.|dos;tres\ncuatro") == ["uno, S.A. de C.V.", "dos", "tres", "cuatro"]
    assert split("a, b,c") == ["a", "b", "c"]
    assert split("a y/o b / c 24/7 / d") == ["a y/o b", "c 24/7", "d"]
    assert split("uno · dos ·  · tres ·") == ["uno", "dos", "tres"]
    assert split("a\tb, c") == ["a", "b, c"]


def test_quotes():
    assert split('"a, b", c, "d ""e"" f"') == ["a, b", "c", 'd "e" f']
    assert split('Gate "exacto" activo|x') == ['Gate "exacto" activo', "x"]
    assert split("'a; b' | 'c' | d") == ["a; b", "c", "d"]
    assert split('["a, b", "\\"c\\" d", "e\\u00e9"]') == ["a, b", '"c" d', "eé"]
    assert split("O'Higgins; D'Elía") == ["O'Higgins", "D'Elía"]
    assert split('un 5" tubo; otro') == ['un 5" tubo', "otro"]


def test_list_marks_and_addresses():
    assert split("1. Uno 2. Dos, con coma 3. Tres") == ["Uno", "Dos, con coma", "Tres"]
    assert split("1) Uno\n2) Dos") == ["Uno", "Dos"]
    assert split("- uno\n- dos, y coma") == ["uno", "dos, y coma"]
    assert split("• uno\n• dos") == ["uno", "dos"]
    assert split("https://a.example/x?o=f;d https://b.example/n,12.html") == ["https://a.example/x?o=f;d", "https://b.example/n,12.html"]
    assert split("https://a.example/n,12.html,https://b.example/?o=f;d") == ["https://a.example/n,12.html", "https://b.example/?o=f;d"]


def test_single_blank_and_long():
    assert split(None, "", "  ", "|;|", "uno", "A costado") == [[], [], [], [], ["uno"], ["A costado"]]
    long = "x" * 1_000_000
    assert split(f"{long}|b") == [long, "b"]
    assert split_cells(pa.array([], pa.string()))[1].to_pylist() == []


def test_round_trips():
    rnd = random.Random(5)
    words = ["marca Ñ", "uno, dos", "#tag", "a y/o b", 'dice "hola"', "24/7", "x (y)"]
    for _ in range(300):
        vals = [rnd.choice(words) for _ in range(rnd.randint(2, 6))]
        assert split(json.dumps(vals, ensure_ascii=False)) == vals
        assert split("|".join(vals)) == vals
        assert split(", ".join('"' + v.replace('"', '""') + '"' for v in vals)) == vals
        batch = ["\n".join(vals), None, "|".join(vals)]
        assert split(*batch) == [vals, [], vals]


def test_explode(spark):
    df = spark.createDataFrame([("a", "x|y|x", 1, "c"), ("a", "x|y|x", 2, "c"), (None, "q", 3, "c"), ("b", None, 4, "c")], "id string, celda string, valor int, clave string")
    rows = sorted(map(tuple, explode_packed(df, "id", "celda").collect()))
    assert rows == [("a", 1, "x"), ("a", 2, "y"), ("a", 3, "x")]
    assert explode_packed(df.where("false"), "id", "celda").count() == 0
