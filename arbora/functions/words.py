"""Text built from names, and word weights, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from arbora.schema import KIND_LABELS

# Words that say nothing about a symbol, in lexical vectors and in cluster labels.
LEXICAL_STOP = "a an and the of to in for on by with function method class params returns self cls this".split()
LABEL_STOP = "self cls args kwargs result data value item items obj get set add the for with and not is in of to a node nodes edge edges".split()
ROOT_DIRS = ("src", "lib", "app", "pkg")


def words(name: Column) -> Column:
    """A camel or snake case name as lower-case words."""
    split = F.regexp_replace(F.regexp_replace(name, r"([A-Z]+)([A-Z][a-z])", "$1 $2"), r"([a-z0-9])([A-Z])", "$1 $2")
    return F.trim(F.lower(F.translate(split, "_-", "  ")))


def module_words(path: Column) -> Column:
    """The last three parts of a path without extension, counted from the first of src, lib, app, pkg if there is one."""
    parts = F.filter(F.split(F.regexp_replace(path, r"\.[^./]+$", ""), "/"), lambda p: p != "")
    marks = F.transform(F.array(*[F.lit(r) for r in ROOT_DIRS]), lambda r: F.array_position(parts, r))
    at = F.array_min(F.filter(marks, lambda i: i > 0))
    rooted = F.when(at.isNotNull(), F.slice(parts, at.cast("int"), F.size(parts))).otherwise(parts)
    return F.array_join(F.slice(rooted, F.greatest(F.size(rooted) - 2, F.lit(1)), 3), " ")


def embedding_text(signature: bool = False) -> Column:
    """The text that a node is embedded by, from the columns of ``nodes``; params and return_type only with ``signature``."""
    label = F.lower("kind")
    for kind, text in KIND_LABELS.items():
        label = F.when(F.col("kind") == kind, text).otherwise(label)
    parent = F.when(F.coalesce("parent_qualified", F.lit("")) != "", F.concat(F.lit("in "), words(F.element_at(F.split("parent_qualified", r"\."), -1))))
    parts = [F.concat_ws(" ", label, words(F.col("name"))), parent]
    if signature:
        own = F.filter("params", lambda p: ~p.isin("self", "cls", "this"))
        parts.append(F.when(F.size(own) > 0, F.concat(F.lit("params "), F.array_join(F.transform(own, words), " "))))
        parts.append(F.when(F.coalesce("return_type", F.lit("")) != "", F.concat(F.lit("returns "), F.col("return_type"))))
    module = module_words(F.col("file_path"))
    parts.append(F.when(module != "", module))
    extra = [F.coalesce(F.get_json_object("extra", f"$.{k}"), F.lit("")) for k in ("http_method", "path", "framework")]
    parts.append(F.when((F.col("kind") == "Endpoint") & ((extra[0] != "") | (extra[1] != "")), F.trim(F.concat_ws(" ", F.lit("endpoint"), *extra))))
    first = F.substring(F.split(F.regexp_replace("docstring", r"^\s+|\s+$", ""), r"\.").getItem(0), 1, 120)
    parts.append(F.when(first != "", first))
    return F.concat_ws(" ", *parts)


def lexical_tokens(text: Column) -> Column:
    """array<struct<token, weight>>: words of two letters or more, 1 each, and ``~`` with the first five letters of longer ones, 0.5."""
    kept = F.filter(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), 1), lambda w: (F.length(w) >= 2) & ~w.isin(LEXICAL_STOP))
    whole = F.transform(kept, lambda w: F.named_struct(F.lit("token"), w, F.lit("weight"), F.lit(1.0)))
    stems = F.transform(F.filter(kept, lambda w: F.length(w) > 5), lambda w: F.named_struct(F.lit("token"), F.concat(F.lit("~"), F.substring(w, 1, 5)), F.lit("weight"), F.lit(0.5)))
    return F.concat(whole, stems)


def label_tokens(name: Column) -> Column:
    """Words of a qualified name's last parts (at most two are split off, the rest stays one) for cluster labels."""
    pieces = F.split(name, r"\.")
    head = F.array_join(F.slice(pieces, 1, F.greatest(F.size(pieces) - 2, F.lit(0))), ".")
    tail = F.slice(pieces, F.greatest(F.size(pieces) - 1, F.lit(1)), 2)
    joined = F.when(F.size(pieces) > 2, F.concat(F.array(head), tail)).otherwise(pieces)
    text = F.array_join(joined, "_")
    split = F.regexp_replace(F.regexp_replace(text, r"([A-Z]+)([A-Z][a-z])", "$1_$2"), r"([a-z0-9])([A-Z])", "$1_$2")
    return F.filter(F.split(F.lower(split), "_"), lambda t: (F.length(t) > 1) & ~t.isin(LABEL_STOP))
