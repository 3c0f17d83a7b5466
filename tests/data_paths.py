"""Folders of the test tables (a module name no other test folder uses)."""

import os

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
