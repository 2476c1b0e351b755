"""Array, segment and sparse-matrix analytics as lazy DataFrame operators."""
