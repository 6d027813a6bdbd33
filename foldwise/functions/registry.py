"""Names, aliases and kinds of the grouped functions."""

from __future__ import annotations

from collections.abc import Callable

REDUCTIONS = ["sum", "prod", "len", "mean", "var", "std", "min", "max", "first", "last", "argmax", "argmin", "sumofsquares", "all", "any", "allnan", "anynan"]
RUNNING = ["cumsum", "cumprod", "cummax", "cummin"]
SORTS, LISTS = ["sort", "rsort"], ["array"]
#: Functions of no NaN-skipping form.
_PLAIN_ONLY = {"allnan", "anynan", "sort", "rsort", "array"}
NAN_FORMS = [f"nan{n}" for n in [*REDUCTIONS, *RUNNING] if n not in _PLAIN_ONLY]
NAMES = [*REDUCTIONS, *RUNNING, *SORTS, *LISTS, *NAN_FORMS]

#: Functions whose result depends on the position of the rows.
NEEDS_POS = {p + n for n in ("first", "last", "argmax", "argmin", *RUNNING) for p in ("", "nan")} | {*SORTS, *LISTS}
BOOLEAN = {"all", "any", "allnan", "anynan", "nanall", "nanany"}
COUNTS = {"len", "nanlen", "argmax", "argmin", "nanargmax", "nanargmin"}

# Other names of the functions. Those of descending sorts mean a descending sort.
ALIASES = {
    "or": "any", "and": "all", "add": "sum", "count": "len", "plus": "sum",
    "multiply": "prod", "product": "prod", "times": "prod",
    "amax": "max", "maximum": "max", "amin": "min", "minimum": "min",
    "split": "array", "splice": "array", "slice": "array", "list": "array",
    "sorted": "sort", "asort": "sort", "asorted": "sort",
    "rsorted": "rsort", "dsort": "rsort", "dsorted": "rsort",
}
# Names under which numpy has a function, where they differ from the alias of that name.
_NUMPY = {"logical_and": "all", "logical_or": "any", "size": "len", "asarray": "array"}


def resolve(func: str | Callable) -> str | Callable:
    """The canonical name of a function: of a name, an alias, a Python builtin or a numpy function.

    Any other callable is returned as it is and is called with each group's values. An unknown name is a
    ValueError.
    """
    if isinstance(func, str):
        if func in NAMES:
            return func
        if func in ALIASES:
            return ALIASES[func]
        raise ValueError(f"no function of the name {func!r}")
    if not callable(func):
        raise TypeError("a function is a name or a callable")
    name = getattr(func, "__name__", "")
    module = getattr(func, "__module__", None) or ""
    known = _NUMPY.get(name, name)
    if module == "builtins" and name in {"all", "any", "len", "max", "min", "sum", "sorted", "slice", "list"}:
        return resolve(name)
    if (module.startswith("numpy") or type(func).__name__ == "ufunc") and known and (known in NAMES or known in ALIASES):
        return resolve(known)
    return func
