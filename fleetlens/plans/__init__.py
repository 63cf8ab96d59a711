"""Multi-operator plans: estimate, sweep and poll cycle, each one lazy query."""
