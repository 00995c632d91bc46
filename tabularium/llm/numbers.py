"""Numbers for things in the order of their first use."""

class Numbers(dict):
    """Numbers things in the order of their first use."""

    def __missing__(self, thing):
        self[thing] = n = len(self)
        return n
