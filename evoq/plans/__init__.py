"""Plans composed of operators: feature table, reports, feature ranking."""
