import ast
from collections import Counter
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
MODULES = [p for folder in ("noticeflow", "workload", "tools", "tests") for p in (ROOT / folder).rglob("*.py")
           if "llm" not in p.parts]


@pytest.mark.parametrize("path", MODULES, ids=lambda p: str(p.relative_to(ROOT)))
def test_no_module_defines_a_name_twice(path):
    """A second function of one name silently replaces the first, whoever calls it."""
    names = Counter(node.name for node in ast.parse(path.read_text()).body
                    if isinstance(node, (ast.FunctionDef, ast.ClassDef)))
    assert [n for n, k in names.items() if k > 1] == []
