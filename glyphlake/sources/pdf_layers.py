"""Optional content of a document: whether a group, a membership or an expression is hidden for a destination.

True is hidden, False visible, None unknown. Unknown is strict: it makes whatever is built on it unknown. What leads back to
itself, or lies more than DEPTH levels down, is unknown too.
"""

from __future__ import annotations

from glyphlake.sources.pdf_objects import Document, Ref

DEPTH = 64
DESTINATIONS = ("view", "print", "export")
#: Where a group's usage has its state for a destination.
USAGE = {"view": ("View", "ViewState"), "print": ("Print", "PrintState"), "export": ("Export", "ExportState")}


class Layers:
    def __init__(self, doc: Document, catalog: dict):
        self.doc = doc
        found = doc.get(catalog.get("OCProperties"))
        self.present = isinstance(found, dict)
        config = doc.get(found.get("D")) if self.present else None
        config = config if isinstance(config, dict) else {}
        names = lambda key: {v.number for v in doc.get(config.get(key), []) or [] if isinstance(v, Ref)}
        base_off = doc.get(config.get("BaseState")) == "OFF"
        self.off = lambda number: (number not in names("ON")) if base_off else number in names("OFF")

    def is_membership(self, value) -> bool:
        node = self.doc.get(value)
        return isinstance(node, dict) and self.doc.get(node.get("Type")) == "OCMD"

    def is_reference(self, value) -> bool:
        node = self.doc.get(value)
        return isinstance(node, dict) and self.doc.get(node.get("Type")) in ("OCG", "OCMD")

    def hidden(self, value, destination: str, path: tuple = ()) -> bool | None:
        node = self.doc.get(value)
        me = value.number if isinstance(value, Ref) else id(node)
        if me in path or len(path) > DEPTH:
            return None
        if not isinstance(node, dict):
            return None
        path = (*path, me)
        kind = self.doc.get(node.get("Type"))
        if kind == "OCG":
            return self._group(value, node, destination)
        if kind == "OCMD":
            rule = self.doc.get(node.get("VE"))
            if isinstance(rule, list) and rule:
                return self._expression(rule, destination, path)
            return self._policy(node, destination, path)
        return False

    def _group(self, value, node: dict, destination: str) -> bool | None:
        part, key = USAGE[destination]
        usage = self.doc.get(node.get("Usage"))
        state = self.doc.get(usage.get(part)) if isinstance(usage, dict) else None
        state = self.doc.get(state.get(key)) if isinstance(state, dict) else None
        if state in ("ON", "OFF"):
            return state == "OFF"
        return self.present and isinstance(value, Ref) and self.off(value.number)

    def _policy(self, node: dict, destination: str, path: tuple) -> bool | None:
        entry = node.get("OCGs")
        groups = self.doc.get(entry)
        groups = groups if isinstance(groups, list) else [entry] if isinstance(groups, dict) else []
        states = [self.hidden(g, destination, path) for g in groups if isinstance(self.doc.get(g), dict)]
        if None in states:
            return None
        if not states:
            return False
        some, every = any(states), all(states)
        return {"AllOn": some, "AnyOff": not some, "AllOff": not every}.get(self.doc.get(node.get("P")), every)

    def _expression(self, rule: list, destination: str, path: tuple) -> bool | None:
        me = ("rule", id(rule))
        if me in path or len(path) > DEPTH or len(rule) < 2:
            return None
        path, states = (*path, me), []
        for operand in rule[1:]:
            node = self.doc.get(operand)
            if isinstance(node, list):
                states.append(self._expression(node, destination, path) if node else False)
            else:
                states.append(self.hidden(operand, destination, path) if isinstance(node, dict) else None)
            if states[-1] is None:
                return None
        op = self.doc.get(rule[0])
        if op == "Not":
            return not states[0] if len(states) == 1 else None
        return {"And": any(states), "Or": all(states)}.get(op)
