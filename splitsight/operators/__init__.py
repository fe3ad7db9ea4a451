"""One module per group of operators; each operator takes and returns DataFrames."""
