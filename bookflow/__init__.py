"""Document analysis and repair on Spark: blocks, rules, layout, reports, packaging."""
