"""Query language: syntax tree, parser and compilation to Columns."""
