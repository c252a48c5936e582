"""Paths that the engine tests share.

They are not in ``conftest``: pytest imports every ``conftest.py`` under the
same module name, so a test that imports from it may get another folder's."""

import os

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF_SMALL = "/root/testdata/sf0.001"
