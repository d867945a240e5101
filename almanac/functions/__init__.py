"""Scalar rules and the fixed tables behind them."""
