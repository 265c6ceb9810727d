"""Plans made of the operators: the whole run, and the registered queries."""
