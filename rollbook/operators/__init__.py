"""DataFrame -> DataFrame operators: fills, positions, cash, orders, signals, reports."""
