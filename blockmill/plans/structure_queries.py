"""Queries over module trees, by name, and their SQL: the expected nodes as values, written by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from blockmill.errors import ParseError
from blockmill.functions import tensors, training
from blockmill.plans import moduletree
from blockmill.plans.moduletree import Module, ModuleTree, Param
from blockmill.plans.registry import query


def _linear(a: int, b: int, n: int) -> Module:
    return Module("Struct:Linear", {"weight": Param(f"P{n}", (a, b)), "bias": Param(f"P{n + 1}", (b,))})


#: n:1 the tuple, n:2 a linear (n:3, n:4), n:5 the array (n:6: n:7, n:8), n:9 the vec (n:A: n:B, n:C; n:D: n:E, n:F)
NESTED = Module("Tuple", [_linear(2, 3, 1), Module("Array", [_linear(4, 5, 3)]), Module("Vec", [_linear(6, 7, 5), _linear(8, 9, 7)])])


def _values(columns: str, *rows: tuple) -> str:
    show = lambda v: "null" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"select * from (values {', '.join('(' + ', '.join(map(show, r)) + ')' for r in rows)}) as v({columns})"


_W = '<Param id="n:2" name="weight" param_id="P1" class="tensor" kind="Float" dtype="F32" shape="2 3" rank="2"/>'
_B = '<Param id="n:3" name="bias" param_id="P2" class="tensor" kind="Float" dtype="F32" shape="3" rank="1"/>'
_LINEAR = f'<Linear id="n:1" class="struct">{_W}{_B}</Linear>'
_XML = f'<XmlModuleTree version="0.1"><Structure>{_LINEAR}</Structure></XmlModuleTree>'


@query(_values("what, shown", ("xml", _XML), ("debug", f"ModuleTree {{{_XML}}}"), ("fragment", _B), ("pretty", '<XmlModuleTree version="0.1">'), ("node", f'    <Linear id="n:1" class="struct">|      {_W}|      {_B}|    </Linear>'), ("indented", "ModuleTree {")))
def tree_texts(spark, sf):
    """The XML of a tree, whole, of a node, and indented."""
    t = ModuleTree.build(spark, _linear(2, 3, 1))
    lines = t.to_xml(True).splitlines()
    rows = [("xml", t.to_xml()), ("debug", t.debug()), ("fragment", t.select("Linear/*[2]").to_fragments()[0]), ("pretty", lines[0]), ("node", "|".join(lines[2:6])), ("indented", t.debug(True).splitlines()[0])]
    return spark.createDataFrame(rows, "what string, shown string")


_PATHS = [
    ("root", lambda t: t.query(), "Structure"),
    ("children", lambda t: t.query().children().children(), "n:2 n:5 n:9"),
    ("named", lambda t: t.select("*/Linear").named_children("bias"), "n:4"),
    ("indexed", lambda t: t.select("*/Vec").indexed_children(1), "n:D"),
    ("subtree", lambda t: t.select("*").subtree_elements("Linear"), "n:2 n:6 n:A n:D"),
    ("descendants", lambda t: t.select("*//Linear"), "n:2 n:6 n:A n:D"),
    ("params", lambda t: t.select("*/Vec").params(), "n:B n:C n:E n:F"),
    ("rank", lambda t: t.query().params().rank(1), "n:4 n:8 n:C n:F"),
    ("filtered", lambda t: t.query().params().filter("@rank=2"), "n:3 n:7 n:B n:E"),
    ("place", lambda t: t.select("Tuple/*[2]/*[1]/*[2]"), "n:8"),
    ("last", lambda t: t.select("*/Vec/*[last()]"), "n:D"),
    ("both", lambda t: t.select("*//Param[@rank=2 and contains(@shape,'6')]"), "n:B"),
    ("either", lambda t: t.select("*//Param[@shape='3' or @shape='9']"), "n:4 n:F"),
    ("neither", lambda t: t.select("*//Param[not(@name='bias' or @rank=1)]"), "n:3 n:7 n:B n:E"),
    ("parents", lambda t: t.select("*//Param[@shape='4 5']/../.."), "n:5"),
    ("ancestors", lambda t: t.select("*/Vec/*[2]/*[1]/ancestor::Vec"), "n:9"),
    ("alternatives", lambda t: t.select("Tuple/(Array|Vec)"), "n:5 n:9"),
    ("nothing", lambda t: t.select("Vec/Nothing"), ""),
]


@query(_values("path, nodes", *((name, nodes) for name, _, nodes in _PATHS)))
def path_nodes(spark, sf):
    """Path queries of every kind over the nested tree, and the nodes that they find in document order."""
    t = ModuleTree.build(spark, NESTED)
    rows = [(name, " ".join(q(t).execute(lambda r: r["id"] or r["elem"]))) for name, q, _ in _PATHS]
    return spark.createDataFrame(rows, "path string, nodes string")


_NODES = [(1, "n:1", "Tuple", "builtin", None, 15, 0), (2, "n:2", "Linear", "struct", None, 4, 1), (3, "n:3", "Param", "tensor", "weight", 3, 2), (4, "n:4", "Param", "tensor", "bias", 4, 2), (5, "n:5", "Array", "builtin", None, 8, 1), (6, "n:6", "Linear", "struct", None, 8, 5), (7, "n:7", "Param", "tensor", "weight", 7, 6), (8, "n:8", "Param", "tensor", "bias", 8, 6), (9, "n:9", "Vec", "builtin", None, 15, 1), (10, "n:A", "Linear", "struct", None, 12, 9), (11, "n:B", "Param", "tensor", "weight", 11, 10), (12, "n:C", "Param", "tensor", "bias", 12, 10), (13, "n:D", "Linear", "struct", None, 15, 9), (14, "n:E", "Param", "tensor", "weight", 14, 13), (15, "n:F", "Param", "tensor", "bias", 15, 13)]


@query(_values("pre, id, elem, class, name, last, parent", *_NODES))
def tree_nodes(spark, sf):
    return ModuleTree.build(spark, NESTED).docs.where("pre > 0").select("pre", "id", "elem", "class", "name", "last", "parent")


@query(_values("place, param_id, kind, dtype, shape, n_bytes, back", (0, "P1", "Float", "F32", "2 3", 24, True), (1, "P2", "Float", "F32", "3", 12, True), (2, "P3", "Float", "F32", "4 5", 80, True), (3, "P4", "Float", "F32", "5", 20, True), (4, "P5", "Float", "F32", "6 7", 168, True), (5, "P6", "Float", "F32", "7", 28, True), (6, "P7", "Float", "F32", "8 9", 288, True), (7, "P8", "Float", "F32", "9", 36, True)))
def param_descs(spark, sf):
    """Descriptions in document order, and whether a node made of one describes the same."""
    t = ModuleTree.build(spark, NESTED)
    rows = [(k, d.param_id, d.tensor.kind, d.tensor.dtype, tensors.shape_to_text(list(d.tensor.shape)), d.tensor.size_estimate, moduletree.desc_of(moduletree.node_of(d)) == d and t.param_ids()[k] == d.param_id) for k, d in enumerate(t.param_descs())]
    return spark.createDataFrame(rows, "place int, param_id string, kind string, dtype string, shape string, n_bytes int, back boolean")


@query(_values("path, code, span", ("Linear[", "XPST0003", "["), ("*[@rank=]", "XPST0003", "@rank="), ("*[@nothing=1]", "XPST0003", "@nothing=1"), ("a b", "XPST0003", " b")))
def path_errors(spark, sf):
    """Paths that are none are refused when they are added; the error shows what it means."""
    t, out = ModuleTree.build(spark, _linear(2, 3, 1)), []
    for path in ("Linear[", "*[@rank=]", "*[@nothing=1]", "a b"):
        try:
            t.select(path)
        except ParseError as e:
            out.append((path, str(e).split(":")[0], e.source[slice(*e.span)]))
    return spark.createDataFrame(out, "path string, code string, span string")


@query(_values("param_id, shape, n_elements", ("p1", "11 8", 88), ("p2", "8 8", 64), ("p3", "8 4", 32), ("p4", "8 4", 32), ("p5", "8 8", 64), ("p6", "8 32", 256), ("p7", "32 8", 256), ("p8", "8 11", 88)))
def config_tree(spark, sf):
    """The parameters of a configured transformer with half as many key and value heads."""
    config = training.GptConfig(vocab_size=11, n_layer=1, n_head=4, n_kv_head=2, n_embed=8)
    rows = ModuleTree.build(spark, moduletree.tree_of(config)).query().params().to_df()
    return rows.select("param_id", tensors.shape_text(F.col("shape")).alias("shape"), tensors.num_elements(F.col("shape")).cast("int").alias("n_elements"))
