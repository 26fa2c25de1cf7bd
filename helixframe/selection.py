"""P1, P2. The atom-selection language and residue masks, as predicates on the atoms' table.

    expression := term ("or" term)*          term := factor ("and" factor)*
    factor     := "not" factor | "(" expression ")" | test | "all" | "none"
    test       := ("name" | "resname" | "type" | "chain") word+        words may hold *
                | ("resid" | "index" | "serial") (number | a:b)+
                | ("resid" | "index" | "serial") (< | <= | > | >= | == | !=) number
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\s*(<=|>=|==|!=|<|>|\(|\)|[\w*'+:.-]+)")
_TEXT = {"name": "atom_name", "resname": "res_name", "type": "element", "element": "element", "chain": "chain_id"}
_NUMBER = ("resid", "index", "serial")
_WORDS = {"and", "or", "not", "(", ")"}


class _Parser:
    def __init__(self, text: str):
        self.text, self.tokens, at = text, [], 0
        text = text.strip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise ValueError(f"cannot read {text[at:]!r} in selection {self.text!r}")
            self.tokens.append(m[1])
            at = m.end()
        self.at = 0

    def peek(self) -> str | None:
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def take(self) -> str:
        if (t := self.peek()) is None:
            raise ValueError(f"selection {self.text!r} ends too early")
        self.at += 1
        return t

    def expression(self) -> Column:
        out = self.term()
        while self.peek() == "or":
            self.take()
            out = out | self.term()
        return out

    def term(self) -> Column:
        out = self.factor()
        while self.peek() == "and":
            self.take()
            out = out & self.factor()
        return out

    def factor(self) -> Column:
        word = self.take()
        if word == "not":
            return ~self.factor()
        if word == "(":
            out = self.expression()
            if self.take() != ")":
                raise ValueError(f"a parenthesis is not closed in {self.text!r}")
            return out
        if word in ("all", "none"):
            return F.lit(word == "all")
        if word in _TEXT:
            return self.words(F.col(_TEXT[word]))
        if word in _NUMBER:
            return self.numbers({"resid": F.col("res_seq"), "index": F.col("atom_idx"), "serial": F.col("atom_idx") + 1}[word])
        raise ValueError(f"unknown word {word!r} in selection {self.text!r}")

    def items(self) -> list[str]:
        out = []
        while (t := self.peek()) is not None and t not in _WORDS:
            out.append(self.take())
        if not out:
            raise ValueError(f"a value is missing in selection {self.text!r}")
        return out

    def words(self, column: Column) -> Column:
        plain, out = [], None
        for w in self.items():
            if "*" in w:
                pattern = "^" + ".*".join(re.escape(p) for p in w.split("*")) + "$"
                out = column.rlike(pattern) if out is None else out | column.rlike(pattern)
            else:
                plain.append(w)
        if plain:
            out = column.isin(plain) if out is None else out | column.isin(plain)
        return out

    def numbers(self, column: Column) -> Column:
        ops = {"<": "__lt__", "<=": "__le__", ">": "__gt__", ">=": "__ge__", "==": "__eq__", "!=": "__ne__"}
        if self.peek() in ops:
            op = self.take()
            return getattr(column, ops[op])(self.number(self.take()))
        out = None
        for item in self.items():
            a, mark, b = item.partition(":")
            one = column.between(self.number(a), self.number(b)) if mark else column == self.number(a)
            out = one if out is None else out | one
        return out

    def number(self, text: str) -> int:
        try:
            return int(text)
        except ValueError:
            raise ValueError(f"{text!r} is no number in selection {self.text!r}") from None


def compile_selection(text: str) -> Column:
    """The predicate on atom_name, res_name, chain_id, res_seq, element, atom_idx that a selection states."""
    parser = _Parser(text)
    if parser.peek() is None:
        raise ValueError("an empty selection")
    out = parser.expression()
    if parser.peek() is not None:
        raise ValueError(f"{parser.peek()!r} is left over in selection {text!r}")
    return out


def resolve_mask(atoms: DataFrame, mask: str) -> DataFrame:
    """P2. serial (from 1) of the atoms that a mask names, in order.

    Tokens are parted by spaces and united: `:1,2` residue numbers, `:RES` residue names in any case,
    `@1,2` serials; others are ignored.  A mask that names nothing is an error.
    """
    numbers, names, serials = set(), set(), set()
    for token in mask.split():
        for part in token[1:].split(","):
            part = part.strip()
            whole = re.fullmatch(r"[+-]?\d+", part)
            if token[0] == ":":
                (numbers if whole else names).add(int(part) if whole else part.upper())
            elif token[0] == "@" and whole:
                serials.add(int(part))
    test = F.col("res_seq").isin(list(numbers)) | F.upper("res_name").isin(list(names)) | (F.col("atom_idx") + 1).isin(list(serials))
    found = atoms.filter(test).select((F.col("atom_idx") + 1).alias("serial")).distinct().orderBy("serial")
    if found.isEmpty():
        raise ValueError(f"mask {mask!r} names no atom")
    return found


def residue_mates(atoms: DataFrame, atom_idx: int) -> DataFrame:
    """P14. The atoms of the residue (number and chain) that an atom belongs to."""
    own = atoms.filter(F.col("atom_idx") == atom_idx).select("res_seq", "chain_id")
    return atoms.join(F.broadcast(own), ["res_seq", "chain_id"], "left_semi")  # one row


def surroundings(atoms: DataFrame, atom_idx: int, reach: int = 5) -> DataFrame:
    """P14. The whole residues of the atoms at most `reach` places before or after an atom."""
    near = atoms.filter(F.col("atom_idx").between(atom_idx - reach, atom_idx + reach)).select("res_seq", "chain_id").distinct()
    return atoms.join(F.broadcast(near), ["res_seq", "chain_id"], "left_semi")  # 2 x reach + 1 rows at most
