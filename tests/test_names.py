"""Every name that a module's functions take from its globals is there, also in queries that no other test calls."""

import builtins
import dis
import importlib
import pkgutil
import types
from pathlib import Path

import pytest

import tangentia

MODULES = sorted(m.name for m in pkgutil.walk_packages(tangentia.__path__, "tangentia.") if not m.ispkg and ".llm" not in m.name)


def _globals(code: types.CodeType) -> set[str]:
    own = {i.argval for i in dis.get_instructions(code) if i.opname == "LOAD_GLOBAL"}
    return own.union(*(_globals(c) for c in code.co_consts if isinstance(c, types.CodeType)))


@pytest.mark.parametrize("name", MODULES)
def test_names_are_defined(name):
    module = importlib.import_module(name)
    path = Path(module.__file__)
    assert _globals(compile(path.read_text(), str(path), "exec")) <= {*vars(module), *dir(builtins)}
