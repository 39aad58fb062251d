"""All oracle queries."""

from oracle import blocks, requests, rules

ORACLE = {**blocks.oracle(), **rules.oracle(), **requests.oracle()}
