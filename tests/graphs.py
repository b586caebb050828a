"""Small graphs used by several tests."""

# The karate club, 34 nodes and 78 edges.
KARATE = {
    0: [1, 2, 3, 4, 5, 6, 7, 8, 10, 11, 12, 13, 17, 19, 21, 31], 1: [2, 3, 7, 13, 17, 19, 21, 30], 2: [3, 7, 8, 9, 13, 27, 28, 32], 3: [7, 12, 13],
    4: [6, 10], 5: [6, 10, 16], 6: [16], 8: [30, 32, 33], 9: [33], 13: [33], 14: [32, 33], 15: [32, 33], 18: [32, 33], 19: [33], 20: [32, 33],
    22: [32, 33], 23: [25, 27, 29, 32, 33], 24: [25, 27, 31], 25: [31], 26: [29, 33], 27: [33], 28: [31, 33], 29: [32, 33], 30: [32, 33], 31: [32, 33], 32: [33],
}
EDGES = [(a, b) for a, near in KARATE.items() for b in near]
# Published placement of the karate club (gamma 2.7248981998107187, T 0.5, m 1): id, angle, radius in order of arrival; fixed values.
PLACED = [
    (33, 3.14159265, 2.96394581), (0, 0.00000001, 3.76764215), (32, 3.10000001, 4.23777436), (2, 6.01000001, 4.57133848),
    (1, 6.12000000, 4.83007091), (3, 6.12000000, 5.04147070), (31, 3.09000000, 5.22020667), (23, 3.67000000, 5.37503481),
    (8, 5.37000000, 5.51160292), (13, 6.13000000, 5.63376724), (30, 5.29000000, 5.74427832), (29, 3.60000000, 5.84516703),
    (27, 3.89000000, 5.93797565), (5, 0.57000000, 6.02390301), (6, 0.57000000, 6.10389946), (7, 5.98000000, 6.17873115),
    (19, 0.16000000, 6.24902471), (24, 3.93000000, 6.31529925), (4, 0.44000000, 6.37798958), (25, 3.76000000, 6.43746358),
    (28, 2.91000000, 6.49403522), (10, 0.45000000, 6.54797466), (16, 0.59000000, 6.59951597), (9, 5.77000000, 6.64886337),
    (14, 3.24000000, 6.69619601), (15, 3.33000000, 6.74167198), (18, 3.00000000, 6.78543147), (20, 3.17000000, 6.82759934),
    (22, 2.82000000, 6.86828733), (12, 6.28000000, 6.90759580), (21, 6.23000000, 6.94561523), (17, 0.06000000, 6.98242748),
    (26, 3.57000000, 7.01810688), (11, 0.25000000, 7.05272105),
]
