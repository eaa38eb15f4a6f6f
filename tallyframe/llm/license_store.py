"""Digests of whole licence texts, made by ``license_digests.known_digests`` from the texts of ``tests/llm/licences.py``."""

from __future__ import annotations

#: Licence and SHA-256 of its canonical text, with owner notices and without (fixed values).
STORED = (
    ("Apache-2.0", "65bfb6f56a10dc6dd6135cf4adeee0f5bc238b3d404067ac48dbf48c0ced3b32"),
    ("Apache-2.0", "769f6cd740fe13ac62c8d735e4f75a44231f944dc392325d819290d7fb6b07e1"),
    ("Apache-2.0", "ed44d69699f98d45c0c3e52ef4574fb05d6045eb6e2cd0e5e3810f6177e87f84"),
    ("Apache-2.0", "ef9aa6097e8b8724e8bedf9a9a264cbc3142b55ef97f3c3f079b7aa1aeac425c"),
    ("Artistic-1.0-Perl", "e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2"),
    ("BSD-2-Clause", "447686a56472ea2e9713ca89034ee666e6646bd1a33eba38690cb875708663e2"),
    ("BSD-2-Clause", "5151319f99abfc15f9a1aab05c799faf3b0e5715fac5a5812b9d3566ae984374"),
    ("BSD-2-Clause", "85c46767b6234227cebe127f5c22b9ede02ee48dda5f148ccefe8432c4d93221"),
    ("BSD-2-Clause", "a56fee4b2f66331ed54da4950ef9c9391453fd1490b4d8ea202bc29683bcbd30"),
    ("BSD-3-Clause", "21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651"),
    ("BSD-3-Clause", "69fcedb70fd1930cb5d773bb71eb605a3aec6362c678302194666d60ca468f71"),
    ("BSD-3-Clause", "94a0a44b170114affb7b3975c6987906dca819b6cbd93510aa70be57345a1e3f"),
    ("BSD-3-Clause", "9b83d3dee0616d07b82a272dd9bf5134a9f402b750f5ee6188458073b0a32ff2"),
    ("BSD-3-Clause", "cc3432eb2f19bb6fe96706bad75b6fce1039db64fb70486899bf6425dea4d9cb"),
    ("BSD-3-Clause", "cc65957a28f15bbcef5b0c23770aae3bd8462cb25904250f77a812ab3b2efe15"),
    ("BSD-3-Clause", "ede163f2edeebd1d089aa16b5c070d0cb609da9e4b54694c28813a0d4b3cbb7a"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "07256c86e2cd85e3172e6fa1c3250663f290578a6261d5d4a94dc56755639d7c"),
    ("GFDL-1.2", "ca8bb52f2f8c90bef811db966e7ae7a70170350fe907e29fa9b53bb3ca03be97"),
    ("GFDL-1.3", "b5dafa4668ce8205dd0435acf2a7bf0f8617abdc18ef04353ebb332354db5c76"),
    ("GFDL-1.3", "f625cbb562e691758bbcfa9cd93f05498e2f171c4a5fedef8b73d9cc4a3453a0"),
    ("GPL-1.0", "113c9f143930d55727a2a62fd203b865910e3acaa4a6e1b493a10120a6632505"),
    ("GPL-1.0", "15fe509fd1670a4bc6550cdf22d98a22b6a704dffdc04f78773ee816bc189a8c"),
    ("GPL-1.0", "2b586535eba0372d11e3149e156d6de6e7021aa029464af9126179c11bead679"),
    ("GPL-1.0", "8a9ccb74f73e459deea9ab73828583de1cd66754c9f8f0699cd2117a96b6b58c"),
    ("GPL-1.0", "a192b46e9f9b36876d0a400e56a75835f94bba1fb63f923e790469df0ce92cdc"),
    ("GPL-1.0", "d4700175993d5644375fc53b8c00c2bef90819b93c3c405a980a004ba9c20ba9"),
    ("GPL-2.0", "1225d02cd36c293fc65ff6aedbed342e33fbb6ff556bc49cb670a60b6992e8c3"),
    ("GPL-2.0", "3598fcacc4a7b55c35196435d0d54f7ebe624e80d45e5d50db7af0706c744103"),
    ("GPL-2.0", "7ce26c9388f0365022d35ab0f0b109d013fde5344f39812f3a7f103d9b187bec"),
    ("GPL-2.0", "92b760016a43c93aca620d59e480f7ee33a2772cc1afbaa8c830ff5aa0d98421"),
    ("GPL-2.0", "b2ee1575f6c71f82554951c67686d7bd064cbabc2097b6c3366908b88c2c0dbf"),
    ("GPL-2.0", "bbceda32bab123a018c60cf4173e9972456bcfbe078082dff55d64e875641b9b"),
    ("GPL-3.0", "4b74e0dd03fd1d107a4985cf04232534603462931b0c161d3287e1fa5db66746"),
    ("GPL-3.0", "57f71ba95bda9ddb21fcd4d2b6841fdc3ef7fcebd5c12a2fd2ee5f2027869fc6"),
    ("GPL-3.0", "5b8bbbc08610f585b26c4d45ec4c46b3a401532b9362524e72b89d9db72bcb4f"),
    ("GPL-3.0", "7a441f15197f86696a85f51672af7a5e5875c084a8ca2bad6d391b9b9646dd1a"),
    ("GPL-3.0", "9ace3ada9ee22ef498a63537f66de8c15281d80cac5e2594cada9954692eff27"),
    ("GPL-3.0", "9c475ed1e924fe0f0e64bc816060f8b770d72c9093b2024c63032292abaecc2d"),
    ("LGPL-2.0", "3c503e1843d56bee44590ba959b2a745cf954688aa5dd285043d139d8c3e6cd6"),
    ("LGPL-2.0", "4401e0261a8caf4fd55eeb0e816fda06bbc9e4b2605767f5ffdf843a5c70e07e"),
    ("LGPL-2.0", "96c47047421b3be5cae9a68c75f37fdcf07945fba0a1d6db6a3b57f9c70f75a0"),
    ("LGPL-2.0", "9ccbf81e2fd78db81966e466a22ed39318d0a4b4550cd69d1144dcf09722ff10"),
    ("LGPL-2.0", "9e78fa98415a9a8c863589ab742457328d22cd2319bbf585de04b27baf33a2be"),
    ("LGPL-2.0", "a1d17eaee69b0acf82494ed25367a5de1fc23474406d17ff81a7b1ee484363e2"),
    ("LGPL-2.1", "599d9303049b507aa89582ee08dd4ddaba298764648558e7bf8e78309807bfaa"),
    ("LGPL-2.1", "a6742add8db4ff9ba6917da0bd1f95927436acfd65ae81933f1e9a859d38d9fa"),
    ("LGPL-2.1", "a9cc8dda4023821e198a2e1bee36afc3e68fce90828780c7bac37ffe33565e15"),
    ("LGPL-2.1", "d00d08192018b2217de04b223449941a18a7cb07d0c025393948065a12eb0fb2"),
    ("LGPL-2.1", "e8ebe2513d0bd90d40bb6e894699a044e69aa9b44afada1fb47e767c3fed7f15"),
    ("LGPL-2.1", "f13ce8aa4b0cc0de7c3b73a95e705f217972ef8710e7c0a463342682e2e523de"),
    ("LGPL-3.0", "3ce770135de37fc153de7af30789ebf6cf1e9ad54eb9b487647ea8aa9ccae9c2"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "3f0343dd4f3b064be36e0c6584737c9b7bb5c322721694563f9009e088ce96d1"),
    ("MPL-2.0", "9eab7902f21bef0326dee4ed0cae1402c781cbf1f8e3dbeed6fbe176d641bb13"),
)
