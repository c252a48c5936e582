"""Operators for preparing large training corpora.

Each module holds one operator with its own general interface; ``queries``
registers the thin per-operator queries.  Nothing outside this subpackage
imports it.

Conventions shared by all operators:

* Rows are identified by ``(id, text)``.  Rows that agree in both are the same
  document and get the same outcome; a null id is a document of its own kind
  that orders after every other id.
* A null text is treated as an empty text unless a docstring says otherwise.
* Only the named id and text columns are read, so extra columns, whatever
  their names, never clash with what an operator computes.
"""
