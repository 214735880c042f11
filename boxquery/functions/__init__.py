"""Column expressions and the Arrow kernels behind them."""
