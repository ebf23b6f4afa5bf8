"""python -m quillon: the version, the operators by module, and the queries."""

from __future__ import annotations

import argparse
import importlib
import inspect
import pkgutil

from . import __version__, operators


def modules() -> list[str]:
    return sorted(m.name for m in pkgutil.iter_modules(operators.__path__) if not m.name.startswith("_"))


def public(name: str) -> list[str]:
    """Functions and classes that a module of operators defines."""
    module = importlib.import_module(f"{operators.__name__}.{name}")
    return sorted(k for k, v in vars(module).items() if not k.startswith("_") and (inspect.isfunction(v) or inspect.isclass(v)) and v.__module__ == module.__name__)


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quillon", description=__doc__)
    commands = parser.add_subparsers(dest="command")
    commands.add_parser("version", help="print the version")
    commands.add_parser("info", help="print the version and the number of operators")
    commands.add_parser("queries", help="list the registered queries")
    listed = commands.add_parser("list", help="list operators")
    listed.add_argument("module", nargs="?", choices=modules())
    told = parser.parse_args(arguments)
    if told.command == "queries":
        from .plans import catalogue

        print(*sorted(catalogue.QUERIES), sep="\n")
    elif told.command == "list":
        for name in [told.module] if told.module else modules():
            print(f"[{name}]", *(f"  {x}" for x in public(name)), sep="\n")
    else:
        print(f"quillon {__version__}")
        if told.command != "version":
            print(*(f"  {name:<18} {len(public(name))}" for name in modules()), sep="\n")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
