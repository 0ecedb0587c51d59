"""The price of a plan before it runs: normalised, estimated and summed in plain Python."""
