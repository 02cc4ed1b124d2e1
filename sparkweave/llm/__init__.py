"""Training-data operators: dedup, tokenisation, filters, language model, packing.

Nothing outside this package imports it.  Every operator takes DataFrames and
selects the columns it needs by name, so extra columns never clash; all its
statistics come from whole tables.  Shared conventions:

* a null text counts as an empty one;
* a null key is kept as its own row and never joined with another;
* an empty table gives an empty result;
* repeated rows give repeated result rows unless the operator says otherwise.
"""
