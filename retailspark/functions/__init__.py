"""Column-level building blocks: exact money sums, exact global ranks,
special functions (log-gamma, Gauss hypergeometric series) and the fixed
label tables."""
